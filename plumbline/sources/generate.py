"""Seeded tables: columns of hash normals over the keys of any table (or of ``spark.range``), and dirty-table recipes."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..operators import inject
from ..operators.table import AuditTable, audit

# fixed values: correlation of the eight sensor readings, in column order
READINGS = ("temperature_c", "humidity_pct", "pressure_hpa", "co2_ppm", "light_lux", "voltage_v", "current_ma", "battery_pct")
CORRELATIONS = {
    ("temperature_c", "humidity_pct"): -0.35, ("temperature_c", "pressure_hpa"): 0.20, ("temperature_c", "co2_ppm"): 0.10,
    ("temperature_c", "light_lux"): 0.05, ("humidity_pct", "pressure_hpa"): -0.10, ("humidity_pct", "co2_ppm"): 0.05,
    ("humidity_pct", "light_lux"): -0.05, ("pressure_hpa", "co2_ppm"): 0.05, ("co2_ppm", "light_lux"): 0.10,
    ("voltage_v", "current_ma"): 0.30, ("voltage_v", "battery_pct"): 0.70, ("current_ma", "battery_pct"): 0.40,
}
# fixed values: (scale, offset, low, high) of each reading; light is exponentiated before clipping
SCALES = {
    "temperature_c": (3.0, 22.0, None, None), "humidity_pct": (10.0, 55.0, 0.0, 100.0),
    "pressure_hpa": (5.0, 1013.25, None, None), "co2_ppm": (150.0, 800.0, 300.0, 5000.0),
    "light_lux": (1.2, 5.0, 0.0, 100000.0), "voltage_v": (0.1, 3.7, 2.0, 4.5),
    "current_ma": (3.0, 15.0, 0.0, 100.0), "battery_pct": (20.0, 60.0, 0.0, 100.0),
}
ZONES = tuple(f"Zone-{letter}" for letter in "ABCDEFGH")
# fixed values: (mean, sigma, multiple) of the malfunction levels
MALFUNCTIONS = {"temperature_c": (22.0, 3.0, 15.0), "co2_ppm": (800.0, 150.0, 12.0), "voltage_v": (3.7, 0.1, 20.0)}
SENSOR_COLUMNS = (*READINGS, "device_id", "location_zone", "alert_level")


@dataclass(frozen=True)
class ErrorRates:
    missing: float = 0.05
    duplicate: float = 0.02
    outlier: float = 0.03
    inconsistency: float = 0.02
    correlation: float = 0.0


def for_table(error_rate: float) -> ErrorRates:
    """Rates of the plain synthetic table."""
    return ErrorRates(error_rate, error_rate * 0.5, error_rate * 0.5, error_rate * 0.3)


def for_sensors(error_rate: float) -> ErrorRates:
    """Rates of the sensor table, each with a floor."""
    return ErrorRates(max(error_rate, 0.08), max(error_rate * 0.4, 0.02), max(error_rate, 0.05), max(error_rate * 0.6, 0.03))


def one_error_type(kind: str, rate: float, others: float = 0.01) -> ErrorRates:
    """One kind of error at ``rate``, the others at 1 %."""
    if kind not in ("missing", "duplicate", "outlier", "inconsistency"):
        raise ValueError(f"unknown error type {kind!r}")
    return replace(ErrorRates(others, others, others, others), **{kind: rate})


# ---- clean tables --------------------------------------------------------------------------------------------------

def row_ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def normals(keys: DataFrame, key_cols: Sequence[str], n_cols: int = 8, seed=42) -> DataFrame:
    """Independent standard normals ``col_0 .. col_{k-1}`` for every row of ``keys``."""
    draws = inject._draws(seed)
    return keys.select(*key_cols, *[draws.normal(f"z{i}", *key_cols).alias(f"col_{i}") for i in range(n_cols)])


def equal_correlation_factor(n_cols: int, rho: float) -> np.ndarray:
    """Lower factor of the equicorrelation matrix; rho is clipped to 0.99 where the matrix is not positive definite."""
    def factor(r):
        return np.linalg.cholesky(np.full((n_cols, n_cols), r) + (1.0 - r) * np.eye(n_cols))
    try:
        return factor(rho)
    except np.linalg.LinAlgError:
        return factor(min(rho, 0.99))


def mix(factor: np.ndarray, z: Sequence[Column]) -> list[Column]:
    """Rows of ``factor`` applied to independent normals, as expressions."""
    mixed = []
    for row in factor:
        total = F.lit(0.0)
        for weight, column in zip(row, z):
            if weight:
                total = total + F.lit(float(weight)) * column
        mixed.append(total)
    return mixed


def correlated_normals(keys: DataFrame, key_cols: Sequence[str], n_cols: int = 8, rho: float = 0.3, seed=42) -> DataFrame:
    """Equicorrelated standard normals."""
    base = normals(keys, key_cols, n_cols, seed)
    mixed = mix(equal_correlation_factor(n_cols, rho), [F.col(f"col_{i}") for i in range(n_cols)])
    return base.select(*key_cols, *[x.alias(f"col_{i}") for i, x in enumerate(mixed)])


def sensor_factor() -> np.ndarray:
    matrix = np.eye(len(READINGS))
    for (a, b), rho in CORRELATIONS.items():
        i, j = READINGS.index(a), READINGS.index(b)
        matrix[i, j] = matrix[j, i] = rho
    return np.linalg.cholesky(matrix)


def alert_level(co2: bool = True) -> Column:
    """critical / warning / normal by fixed thresholds on the readings."""
    t, v = F.col("temperature_c"), F.col("voltage_v")
    raised, severe = (t > 35) | (v < 2.5), t > 45
    if co2:
        raised, severe = raised | (F.col("co2_ppm") > 2000), severe | (F.col("co2_ppm") > 3500)
    return F.when(raised, F.when(severe, "critical").otherwise("warning")).otherwise("normal")


def sensors(keys: DataFrame, key_cols: Sequence[str], n_devices: int = 200, seed=42) -> DataFrame:
    """Sensor-shaped rows for every row of ``keys``: eight correlated readings, device, zone by device, alert level."""
    draws = inject._draws(seed)
    z = keys.select(*key_cols, *[draws.normal(f"z{i}", *key_cols).alias(f"z_{i}") for i in range(len(READINGS))],
                    (draws.integer(n_devices, "device", *key_cols) + 1).alias("device_no"))
    mixed = dict(zip(READINGS, mix(sensor_factor(), [F.col(f"z_{i}") for i in range(len(READINGS))])))
    columns = []
    for name in READINGS:
        scale, offset, low, high = SCALES[name]
        value = mixed[name] * scale + offset
        value = F.exp(value) if name == "light_lux" else value
        columns.append((value if low is None else F.least(F.greatest(value, F.lit(low)), F.lit(high))).alias(name))
    zone = F.element_at(F.array(*[F.lit(x) for x in ZONES]), F.pmod(F.col("device_no") - 1, F.lit(len(ZONES))) + 1)
    device = F.format_string("dev_%04d", F.col("device_no"))
    return z.select(*key_cols, *columns, device.alias("device_id"), zone.alias("location_zone")).withColumn("alert_level", alert_level())


# ---- dirty tables --------------------------------------------------------------------------------------------------

def _audited(df: DataFrame, key_cols, rules, name) -> AuditTable:
    keys = [*key_cols, inject.COPY_NO]
    return audit(df, keys, [c for c in df.columns if c not in keys], rules, name)


def dirty_numeric_table(keys: DataFrame, key_cols: Sequence[str], n_cols: int = 8, rates: ErrorRates = ErrorRates(),
                        seed: int = 42, name: str = "numeric") -> AuditTable:
    """Normals, then missing cells, copies of dirty rows, outliers, and a broken col_0 -> col_1."""
    if rates.correlation > 0:
        clean = correlated_normals(keys, key_cols, n_cols, rates.correlation, seed)
    else:
        clean = normals(keys, key_cols, n_cols, seed)
    columns = [c for c in clean.columns if c not in key_cols]
    dirty = inject.inject_missing(clean, rates.missing, key_cols, columns, seed)
    dirty = inject.inject_duplicates(dirty, rates.duplicate, key_cols, seed)
    # later damage falls on original rows only
    original = F.col(inject.COPY_NO) == 0
    hit = inject.inject_outliers(dirty.where(original), rates.outlier, key_cols, columns, seed, clean)
    rules = {}
    if rates.inconsistency > 0 and n_cols >= 2:
        hit, rules = inject.inject_fd_noise(hit, rates.inconsistency, key_cols, "col_1", seed), {"col_0": "col_1"}
    return _audited(hit.unionByName(dirty.where(~original)), key_cols, rules, name)


def dirty_mixed_table(df: DataFrame, key_cols: Sequence[str], error_rate: float = 0.05, seed: int = 42,
                      name: str = "mixed", rules=None) -> AuditTable:
    """For an existing table: missing cells in every column, outliers, and copies of clean rows."""
    columns = [c for c in df.columns if c not in key_cols]
    dirty = inject.inject_missing(df, error_rate, key_cols, columns, seed, mode="bernoulli")
    dirty = inject.replace_with_outliers(dirty, error_rate, key_cols, columns, seed)
    clean = df.select(*[F.col(c).cast(dirty.schema[c].dataType) for c in dirty.columns])
    return _audited(inject.inject_duplicates(dirty, error_rate * 0.5, key_cols, seed, source=clean), key_cols, rules, name)


def dirty_sensor_table(keys: DataFrame, key_cols: Sequence[str], n_devices: int | None = None,
                       rates: ErrorRates = for_sensors(0.05), seed: int = 42, name: str = "sensor") -> AuditTable:
    """Sensors, then missing readings, malfunction levels, copies of clean rows, and devices in a second zone.

    About fifty rows per device unless ``n_devices`` says otherwise.
    """
    if n_devices is None:
        n_devices = max(1, keys.count() // 50)
    clean = sensors(keys, key_cols, n_devices, seed)
    dirty = inject.inject_missing(clean, rates.missing, key_cols, READINGS, seed)
    dirty = inject.inject_levels(dirty, rates.outlier, key_cols, MALFUNCTIONS, seed)
    dirty = inject.inject_duplicates(dirty, rates.duplicate, key_cols, seed, source=clean)
    dirty = inject.inject_fd_per_key(dirty, rates.inconsistency, [*key_cols, inject.COPY_NO], "device_id", "location_zone", ZONES, seed)
    return _audited(dirty, key_cols, {"device_id": "location_zone"}, name)


def dirty_fitted_table(df: DataFrame, key_cols: Sequence[str], error_rate: float = 0.05, seed: int = 42,
                       name: str = "fitted") -> AuditTable:
    """Missing numeric cells and copies of clean rows; the rule is first -> second numeric column, unbroken by us."""
    numeric = [c for c in numeric_columns(df) if c not in key_cols]
    dirty = inject.inject_missing(df, error_rate, key_cols, numeric, seed)
    dirty = inject.inject_duplicates(dirty, error_rate / 2, key_cols, seed, source=df)
    return _audited(dirty, key_cols, {numeric[0]: numeric[1]} if len(numeric) >= 2 else None, name)
