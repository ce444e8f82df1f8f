"""Delimited logs and all-text CSV, parsed and cleaned with built-in expressions (gzip is read as is, one task per file)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import Draws
from .generate import SENSOR_COLUMNS, ZONES, alert_level

# fixed values: positions of the sensor log, texts that mean missing, and name parts of columns that hold numbers
LOG_COLUMNS = ("date", "time", "epoch", "moteid", "temperature_c", "humidity_pct", "light_lux", "voltage_v")
LOG_NUMBERS = ("epoch", "moteid", "temperature_c", "humidity_pct", "light_lux", "voltage_v")
MISSING_TEXTS = ("", "NA", "nan", "NaN")
NUMBER_NAMES = ("year", "age", "time", "speed", "distance", "perf")
# fixed values: (mean, sd, low, high) of the filler readings
FILLERS = {"pressure_hpa": (1013.25, 5.0, None, None), "co2_ppm": (800.0, 150.0, 300.0, 5000.0),
           "current_ma": (15.0, 3.0, 0.0, 100.0), "battery_pct": (60.0, 20.0, 0.0, 100.0)}


def read_csv_as_text(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV with every column as a string; the schema is given, so nothing is inferred."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path if isinstance(path, str) else list(path), schema=schema, header=header)


def coerce_numeric(df: DataFrame, parts: Sequence[str] = NUMBER_NAMES) -> DataFrame:
    """String columns whose name contains one of ``parts`` become DOUBLE; text that is no number becomes NULL."""
    changes = {c: F.expr(f"try_cast(trim(`{c}`) as double)") for c in df.columns
               if isinstance(df.schema[c].dataType, T.StringType) and any(p in c.lower() for p in parts)}
    return df.withColumns(changes) if changes else df


def read_log_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_log_lines(spark.read.text(path if isinstance(path, str) else list(path)), "value")


def parse_log_lines(lines: DataFrame, column: str = "value", names: Sequence[str] = LOG_COLUMNS,
                    numbers: Sequence[str] = LOG_NUMBERS, keep: Sequence[str] = ()) -> DataFrame:
    """Whitespace-separated fields by position.  Blank lines and lines with too many fields are dropped, short ones padded."""
    fields = F.split(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")), " ")
    split = lines.select(*keep, fields.alias("fields"), F.length(F.trim(F.col(column))).alias("len"))
    split = split.where((F.size("fields") <= len(names)) & (F.col("len") > 0))
    out = []
    for i, name in enumerate(names):
        text = F.get("fields", F.lit(i))
        text = F.when(~text.isin(*MISSING_TEXTS), text)
        out.append((text.try_cast("double") if name in numbers else text).alias(name))
    return split.select(*keep, *out)


def clean_log(df: DataFrame, seed: int | None = None, key_cols: Sequence[str] = ()) -> DataFrame:
    """Drop rows without id or temperature, derive device, zone and alert level, and select the canonical columns.

    With ``seed`` the readings the log lacks are filled with clipped hash normals per row key.
    """
    rows = df.na.drop(subset=["moteid", "temperature_c"]).withColumn("mote", F.col("moteid").cast("bigint"))
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.pmod("mote", F.lit(len(ZONES))) + 1).cast("int"))
    rows = rows.withColumns({"device_id": F.format_string("dev_%04d", "mote"), "location_zone": zone, "alert_level": alert_level(co2=False)})
    if seed is not None:
        rows = rows.withColumns(filler_columns(seed, key_cols))
    return rows.select(*[c for c in (*key_cols, *SENSOR_COLUMNS) if c in rows.columns])


def filler_columns(seed: int, key_cols: Sequence[str]) -> dict[str, Column]:
    draws = Draws(seed)
    filled = {}
    for name, (mean, sd, low, high) in FILLERS.items():
        value = F.lit(mean) + F.lit(sd) * draws.normal(f"fill:{name}", *key_cols)
        filled[name] = value if low is None else F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return filled


def read_together(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several Parquet tables as one, matched by column name; a column absent from one of them is NULL there."""
    frames = [spark.read.parquet(p) for p in paths]
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return whole
