"""Sources: generated columns, dirty-table recipes, ingest, catalog and caches."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators.profile import INDICATORS, profile_table
from ..operators.storage import shared_folder
from ..operators.table import audit
from ..sources import cache, catalog, generate, ingest
from .base import (Check, copies_sql, d, load, missing_sql, normal, once, outlier_sql, profile_sql, rounded, sign, u)
from .inject_checks import fd_per_key_sql

SEED = 42
ORDERS, EVENTS = ["o_orderkey"], ["event_id"]
COLUMNS = [f"col_{i}" for i in range(4)]


def _order_keys(spark, folder):
    return load(spark, folder, "orders").select(*ORDERS)


def _event_keys(spark, folder):
    return load(spark, folder, "events").select(*EVENTS)


def generate_normals(spark, folder):
    return rounded(generate.normals(_order_keys(spark, folder), ORDERS, 4, SEED), COLUMNS)


def generate_correlated(spark, folder):
    return rounded(generate.correlated_normals(_order_keys(spark, folder), ORDERS, 4, 0.5, SEED), COLUMNS)


def generate_sensors(spark, folder):
    return rounded(generate.sensors(_event_keys(spark, folder), EVENTS, 200, SEED), generate.READINGS, 5)


def _profiled(name, build):
    def run(spark, folder):
        t = build(spark, folder)
        written = once(spark, folder, f"recipe_{name}", lambda: t.df)
        return rounded(profile_table(t.with_rows(written))).select(*INDICATORS, "sample_size")
    return run


RATES = generate.ErrorRates()
SENSOR_RATES = generate.for_sensors(0.05)


def _numeric(spark, folder):
    return generate.dirty_numeric_table(_order_keys(spark, folder), ORDERS, 4, RATES, SEED)


def _numeric_one_error(spark, folder):
    return generate.dirty_numeric_table(_order_keys(spark, folder), ORDERS, 4, generate.one_error_type("duplicate", 0.2), SEED)


def _mixed(spark, folder):
    return generate.dirty_mixed_table(load(spark, folder, "customer"), ["c_custkey"], 0.05, SEED)


def _sensor(spark, folder):
    return generate.dirty_sensor_table(_event_keys(spark, folder), EVENTS, 200, SENSOR_RATES, SEED)


def _fitted(spark, folder):
    df = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return generate.dirty_fitted_table(df, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], 0.05, SEED)


# ---- ingest --------------------------------------------------------------------------------------------------------
# events written as sensor log lines, with absent ids, short lines, lines with too many fields, and odd spacing;
# the text of the expression is understood by both engines
LINE = ("'d' || CAST(event_id % 30 AS STRING) || '  t' || CAST(event_id AS STRING) || ' ' || CAST(event_id AS STRING) || ' ' || "
        "CASE WHEN user_id % 19 = 0 THEN 'NA' WHEN user_id % 23 = 0 THEN 'mote' ELSE CAST(user_id AS STRING) END"
        " || CASE WHEN event_id % 11 = 0 THEN '' ELSE '   ' || CASE WHEN event_id % 13 = 0 THEN 'nan' ELSE CAST(event_id % 60 AS STRING) END"
        " || ' ' || CAST(event_id % 100 AS STRING) || ' ' || CAST(event_id % 700 AS STRING) || ' ' || CAST(event_id % 4 AS STRING) END"
        " || CASE WHEN event_id % 17 = 0 THEN ' 1 2 3 4 5' ELSE '' END")


def _lines(spark, folder):
    return load(spark, folder, "events").select("event_id", F.expr(LINE).alias("value"))


def ingest_log_lines(spark, folder):
    """Parsed from text files written by Spark and read back as lines."""
    path = f"{shared_folder(spark)}/lines-{cache.parameter_key(folder=folder, app=spark.sparkContext.applicationId)}"
    _lines(spark, folder).select("value").write.mode("overwrite").text(path, compression="gzip")
    return ingest.read_log_lines(spark, path)


def clean_log(spark, folder):
    """Device, zone and alert level of the usable lines, with filler readings."""
    parsed = ingest.parse_log_lines(_lines(spark, folder), keep=["event_id"])
    return rounded(ingest.clean_log(parsed, SEED, ["event_id"]), ["pressure_hpa", "co2_ppm", "current_ma", "battery_pct"], 5)


TEXTS = ("CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 5 = 0 THEN ' ' || CAST(user_id AS STRING) || ' ' ELSE CAST(user_id AS STRING) END")


def coerce_numeric(spark, folder):
    """All-text CSV written and read back; columns named like numbers become numbers."""
    path = f"{shared_folder(spark)}/csv-{cache.parameter_key(folder=folder, app=spark.sparkContext.applicationId)}"
    text = load(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"), F.expr(TEXTS).alias("athlete_age"),
                                                F.col("event_type").alias("kind"), F.expr("CAST(event_id % 90 AS STRING) || ' km'").alias("distance"))
    text.write.mode("overwrite").csv(path, header=True)
    return ingest.coerce_numeric(ingest.read_csv_as_text(spark, path, ["id", "athlete_age", "kind", "distance"]))


def read_together(spark, folder):
    """Two tables matched by column name."""
    a = load(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = load(spark, folder, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"))
    return ingest.read_together(spark, [_stored(spark, folder, "part_a", a), _stored(spark, folder, "part_b", b)])


def _stored(spark, folder, name, df):
    path = f"{shared_folder(spark)}/{name}-{cache.parameter_key(folder=folder, app=spark.sparkContext.applicationId)}"
    df.write.mode("overwrite").parquet(path)
    return path


def catalog_capped(spark, folder):
    """A named dataset with its row cap at load."""
    tables = catalog.folder_catalog(folder, {"events": {"key_cols": ("event_id",), "rules": {"user_id": "event_type"}}})
    t, _ = tables.load(spark, "events", n_records=700, seed=SEED)
    return t.df.select("event_id", "event_type")


def truth_from_cache(spark, folder):
    """Ground truth written as JSON once and read back."""
    docs = audit(load(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars"), ["doc_id"], ["text", "lang", "n_chars"], {"text": "lang"}, "documents")
    root = f"{shared_folder(spark)}/truth-{spark.sparkContext.applicationId}"
    cache.truth_profile(docs, root, folder=folder)
    return rounded(cache.truth_profile(docs, root, folder=folder)).select(*INDICATORS, "sample_size")


def cached_table(spark, folder):
    """A derived table written once per parameter set."""
    root = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    build = lambda: load(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    cache.cached_table(spark, root, "priorities", build, folder=folder)
    return cache.cached_table(spark, root, "priorities", build, folder=folder)


# ---- SQL -----------------------------------------------------------------------------------------------------------

def _normals_sql(src, keys, n):
    return f"SELECT {', '.join([*keys, *[f'{normal(SEED, f'z{i}', *keys)} AS col_{i}' for i in range(n)]])} FROM {src}"


def _mixed_sql(factor, names):
    return [" + ".join(f"{d(w)} * {n}" for w, n in zip(row, names) if w) for row in factor]


_corr = _mixed_sql(generate.equal_correlation_factor(4, 0.5), COLUMNS)
_z = [f"z_{i}" for i in range(8)]


def _sensor_sql(src="events", digits=None):
    cells = []
    for name, mixed in zip(generate.READINGS, _mixed_sql(generate.sensor_factor(), _z)):
        scale, offset, low, high = generate.SCALES[name]
        value = f"(({mixed}) * {d(scale)} + {d(offset)})"
        value = f"exp({value})" if name == "light_lux" else value
        value = value if low is None else f"least(greatest({value}, {d(low)}), {d(high)})"
        cells.append(f"{value} AS {name}")
    zones = "[" + ", ".join(f"'{z}'" for z in generate.ZONES) + "]"
    inner = (f"SELECT event_id, {', '.join(f'{normal(SEED, f'z{i}', 'event_id')} AS z_{i}' for i in range(8))}, "
             f"CAST(floor({u(SEED, 'device', 'event_id')} * 200.0::DOUBLE) AS INTEGER) + 1 AS device_no FROM {src}")
    rows = f"SELECT event_id, {', '.join(cells)}, 'dev_' || lpad(CAST(device_no AS VARCHAR), 4, '0') AS device_id, {zones}[(device_no - 1) % 8 + 1] AS location_zone FROM ({inner}) z"
    alert = ("CASE WHEN temperature_c > 35 OR voltage_v < 2.5 OR co2_ppm > 2000 THEN CASE WHEN temperature_c > 45 OR co2_ppm > 3500 THEN 'critical' ELSE 'warning' END ELSE 'normal' END")
    shown = [f"round({c}, {digits}) AS {c}" if digits else c for c in generate.READINGS]
    return f"SELECT event_id, {', '.join(shown)}, device_id, location_zone, {alert} AS alert_level FROM ({rows}) r"


def _numeric_sql(rates):
    clean = f"clean AS MATERIALIZED ({_normals_sql('orders', ORDERS, 4)})"
    holes = f"holes AS ({missing_sql('clean', ORDERS, COLUMNS, -math.expm1(-rates.missing), SEED)})"
    copies = f"copies AS MATERIALIZED ({copies_sql('holes', 'holes', ORDERS, COLUMNS, rates.duplicate, SEED)})"
    shifted = outlier_sql("(SELECT * FROM copies WHERE copy_no = 0)", ORDERS, COLUMNS, ["copy_no"], rates.outlier, SEED, "clean")
    share = d(-math.expm1(-rates.inconsistency))
    noise = (f"CASE WHEN {u(SEED, 'break:col_1', 'o_orderkey')} < {share} THEN -100.0 + 200.0 * {u(SEED, 'noise:col_1', 'o_orderkey')} ELSE col_1 END AS col_1")
    dirty = f"dirty AS (SELECT o_orderkey, col_0, {noise}, col_2, col_3 FROM ({shifted}) s UNION ALL SELECT o_orderkey, col_0, col_1, col_2, col_3 FROM copies WHERE copy_no > 0)"
    return f"WITH {clean}, {holes}, {copies}, {dirty} " + profile_sql("dirty", COLUMNS, COLUMNS, [("col_0", "col_1")])


_CUSTOMER = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _mixed_table_sql():
    holes = f"holes AS MATERIALIZED ({missing_sql('customer', ['c_custkey'], _CUSTOMER, 0.05, SEED)})"
    stats = "stats AS (SELECT count(*) AS n, " + ", ".join(f"count({c}) AS n_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in ("c_nationkey", "c_acctbal")) + " FROM holes)"
    hit = {c: f"CASE WHEN {u(SEED, f'outlier:{c}', 'c_custkey')} < 1.0 - exp(-greatest(1.0, floor(n * 0.0125::DOUBLE)) / n) AND n_{c} >= 4 "
              f"THEN mean_{c} + {sign(SEED, f'sign:{c}', 'c_custkey')} * 10.0 * (sd_{c} + 1e-6) ELSE CAST({c} AS DOUBLE) END AS {c}" for c in ("c_nationkey", "c_acctbal")}
    dirty = f"damaged AS (SELECT c_custkey, c_name, {hit['c_nationkey']}, {hit['c_acctbal']}, c_mktsegment FROM holes CROSS JOIN stats)"
    return f"WITH {holes}, {stats}, {dirty}, dirty AS ({copies_sql('damaged', 'customer', ['c_custkey'], _CUSTOMER, 0.025, SEED)}) " + profile_sql(
        "dirty", _CUSTOMER, ["c_nationkey", "c_acctbal"])


def _sensor_table_sql():
    r, columns = SENSOR_RATES, list(generate.SENSOR_COLUMNS)
    labels = ["device_id", "location_zone", "alert_level"]
    clean = f"clean AS MATERIALIZED ({_sensor_sql()})"
    holes = f"holes AS ({missing_sql('clean', EVENTS, generate.READINGS, -math.expm1(-r.missing), SEED, labels)})"
    share = d(-math.expm1(-r.outlier / len(generate.MALFUNCTIONS)))
    level = {c: f"CASE WHEN {u(SEED, f'level:{c}', 'event_id')} < {share} THEN {d(mu)} + {sign(SEED, f'sign:{c}', 'event_id')} * {d(k * s)} ELSE {c} END AS {c}"
             for c, (mu, s, k) in generate.MALFUNCTIONS.items()}
    broken = f"levels AS (SELECT event_id, {', '.join(level.get(c, c) for c in columns)} FROM holes)"
    copies = f"copies AS MATERIALIZED ({copies_sql('levels', 'clean', EVENTS, columns, r.duplicate, SEED)})"
    others = [c for c in columns if c not in ("device_id", "location_zone")]
    dirty = f"dirty AS ({fd_per_key_sql('copies', ['event_id', 'copy_no'], 'device_id', 'location_zone', generate.ZONES, r.inconsistency, others)})"
    return f"WITH {clean}, {holes}, {broken}, {copies}, {dirty} " + profile_sql("dirty", columns, list(generate.READINGS), [("device_id", "location_zone")])


_FIT_KEY, _FIT = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax", "l_returnflag"]


def _fitted_sql():
    holes = f"holes AS ({missing_sql('lineitem', _FIT_KEY, _FIT[:3], -math.expm1(-0.05), SEED, ['l_returnflag'])})"
    return f"WITH {holes}, dirty AS ({copies_sql('holes', 'lineitem', _FIT_KEY, _FIT, 0.025, SEED)}) " + profile_sql("dirty", _FIT, _FIT[:3], [("l_quantity", "l_discount")])


_fields = f"(SELECT event_id, string_split(regexp_replace(trim({LINE}), '\\s+', ' ', 'g'), ' ') AS f FROM events)"
_text = "CASE WHEN f[{i}] NOT IN ('', 'NA', 'nan', 'NaN') THEN f[{i}] END"
_parsed = ("SELECT event_id, " + ", ".join(
    (f"TRY_CAST({_text.format(i=i)} AS DOUBLE)" if n in ingest.LOG_NUMBERS else _text.format(i=i)) + f" AS {n}" for i, n in enumerate(ingest.LOG_COLUMNS, start=1))
    + f" FROM {_fields} t WHERE len(f) <= 8")


def _filler(name):
    mean, sd, low, high = ingest.FILLERS[name]
    value = f"({d(mean)} + {d(sd)} * {normal(SEED, f'fill:{name}', 'event_id')})"
    return f"round({value if low is None else f'least(greatest({value}, {d(low)}), {d(high)})'}, 5) AS {name}"


_zones = "[" + ", ".join(f"'{z}'" for z in generate.ZONES) + "]"
_cleaned = (f"SELECT event_id, temperature_c, humidity_pct, light_lux, voltage_v, {', '.join(_filler(n) for n in ingest.FILLERS)}, "
            f"'dev_' || lpad(CAST(CAST(moteid AS BIGINT) AS VARCHAR), 4, '0') AS device_id, {_zones}[CAST(moteid AS BIGINT) % 8 + 1] AS location_zone, "
            "CASE WHEN coalesce(temperature_c > 35, FALSE) OR coalesce(voltage_v < 2.5, FALSE) THEN CASE WHEN temperature_c > 45 THEN 'critical' ELSE 'warning' END ELSE 'normal' END AS alert_level "
            f"FROM ({_parsed}) p WHERE moteid IS NOT NULL AND temperature_c IS NOT NULL")

CHECKS = {
    "generate_normals": Check(generate_normals, f"SELECT o_orderkey, {', '.join(f'round(col_{i}, 6) AS col_{i}' for i in range(4))} FROM ({_normals_sql('orders', ORDERS, 4)}) t"),
    "generate_correlated": Check(generate_correlated, f"SELECT o_orderkey, {', '.join(f'round({x}, 6) AS col_{i}' for i, x in enumerate(_corr))} FROM ({_normals_sql('orders', ORDERS, 4)}) t"),
    "generate_sensors": Check(generate_sensors, _sensor_sql(digits=5)),
    "dirty_numeric_profile": Check(_profiled("numeric", _numeric), _numeric_sql(RATES)),
    "dirty_one_error_profile": Check(_profiled("one_error", _numeric_one_error), _numeric_sql(generate.one_error_type("duplicate", 0.2))),
    "dirty_mixed_profile": Check(_profiled("mixed", _mixed), _mixed_table_sql()),
    "dirty_sensor_profile": Check(_profiled("sensor", _sensor), _sensor_table_sql()),
    "dirty_fitted_profile": Check(_profiled("fitted", _fitted), _fitted_sql()),
    "ingest_log_lines": Check(ingest_log_lines, f"SELECT {', '.join(ingest.LOG_COLUMNS)} FROM ({_parsed}) p"),
    "clean_log": Check(clean_log, _cleaned),
    "coerce_numeric": Check(coerce_numeric, f"SELECT CAST(event_id AS VARCHAR) AS id, TRY_CAST(trim({TEXTS}) AS DOUBLE) AS athlete_age, event_type AS kind, CAST(NULL AS DOUBLE) AS distance FROM events"),
    "read_together": Check(read_together, "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier"),
    "catalog_capped": Check(catalog_capped, f"SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY {u(SEED, 'row', 'event_id')}, event_id) AS rn FROM events) r WHERE rn <= 700"),
    "truth_from_cache": Check(truth_from_cache, profile_sql("documents", ["text", "lang", "n_chars"], ["n_chars"], [("text", "lang")])),
    "cached_table": Check(cached_table, "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1"),
}
