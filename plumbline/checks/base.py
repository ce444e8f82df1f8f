"""Shared pieces of the checks: loading tables, the dirtied line items, and SQL fragments for the same definitions."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inject
from ..operators.profile import INDICATORS
from ..operators.storage import materialise, spread
from ..operators.table import AuditTable, audit


@dataclass(frozen=True)
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, columns: Sequence[str] = INDICATORS, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


# ---- SQL fragments -------------------------------------------------------------------------------------------------

def u(seed, tag: str, *keys: str, half: int = 0) -> str:
    parts = ", ".join([f"'{seed}'" if isinstance(seed, int) else f"CAST({seed} AS VARCHAR)", f"'{tag}'",
                       *[f"coalesce(CAST({k} AS VARCHAR), '<null>')" for k in keys]])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {parts})), {1 + 13 * half}, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def expo(seed, tag: str, *keys: str) -> str:
    return f"(-ln({u(seed, tag, *keys)} + 1.1102230246251565e-16::DOUBLE))"


def normal(seed, tag: str, *keys: str) -> str:
    return (f"(sqrt(-2.0::DOUBLE * ln({u(seed, tag, *keys)} + 1.1102230246251565e-16::DOUBLE))"
            f" * cos(6.283185307179586::DOUBLE * {u(seed, tag, *keys, half=1)}))")


def sign(seed, tag: str, *keys: str) -> str:
    return f"(CASE WHEN {u(seed, tag, *keys)} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def integer_part(n: str, share: float) -> str:
    return f"CAST(floor({n} * {d(share)}) AS BIGINT)"


def fence_sql(src: str, numeric: Sequence[str], rule: str = "profile", group: Sequence[str] = ()) -> str:
    """SELECT of low_i / high_i per group."""
    sd = "stddev_samp" if rule == "profile" else "stddev_pop"
    cols = []
    for i, c in enumerate(numeric):
        x = f"CAST({c} AS DOUBLE)"
        q1, q3 = f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.75)"
        if rule == "tukey":
            low, high = f"CASE WHEN {q3} > {q1} THEN {q1} - 1.5 * ({q3} - {q1}) END", f"CASE WHEN {q3} > {q1} THEN {q3} + 1.5 * ({q3} - {q1}) END"
        else:
            low = f"CASE WHEN {q3} = {q1} THEN avg({x}) - 3.0 * ({sd}({x}) + 1e-9) ELSE {q1} - 1.5 * ({q3} - {q1}) END"
            high = f"CASE WHEN {q3} = {q1} THEN avg({x}) + 3.0 * ({sd}({x}) + 1e-9) ELSE {q3} + 1.5 * ({q3} - {q1}) END"
        if rule == "profile":
            low, high = f"CASE WHEN count({c}) >= 4 THEN {low} END", f"CASE WHEN count({c}) >= 4 THEN {high} END"
        cols += [f"{low} AS low_{i}", f"{high} AS high_{i}"]
    keys = ", ".join(group)
    return f"SELECT {keys + ', ' if group else ''}{', '.join(cols)} FROM {src}" + (f" GROUP BY {keys}" if group else "")


def flag_sql(src: str, measured, numeric, rules=(), group=(), keep: str = "s.*") -> str:
    """Row flags of a table by windows: null_cells, is_duplicate, is_outlier, is_inconsistent."""
    g = list(group)
    nulls = " + ".join(f"CASE WHEN s.{c} IS NULL THEN 1 ELSE 0 END" for c in measured)
    out = " OR ".join(f"coalesce(s.{c} < f.low_{i} OR s.{c} > f.high_{i}, FALSE)" for i, c in enumerate(numeric)) or "FALSE"
    broken = []
    for det, dep in rules:
        det = [det] if isinstance(det, str) else list(det)
        part = ", ".join(f"s.{c}" for c in [*g, *det])
        known = " AND ".join(f"s.{c} IS NOT NULL" for c in det)
        broken.append(f"({known} AND coalesce(min(s.{dep}) OVER (PARTITION BY {part}) <> max(s.{dep}) OVER (PARTITION BY {part}), FALSE))")
    join = ""
    if numeric:
        fence = fence_sql(src, numeric, "profile", g)
        on = " AND ".join(f"s.{c} IS NOT DISTINCT FROM f.{c}" for c in g)
        join = f" JOIN ({fence}) f ON {on}" if g else f" CROSS JOIN ({fence}) f"
    same = ", ".join(f"s.{c}" for c in [*g, *measured])
    return (f"SELECT {keep}, {nulls} AS null_cells, count(*) OVER (PARTITION BY {same}) > 1 AS is_duplicate, "
            f"({out}) AS is_outlier, ({' OR '.join(broken) or 'FALSE'}) AS is_inconsistent FROM {src} s{join}")


def profile_sql(src: str, measured, numeric, rules=(), group=(), weight: str | None = None, digits: int | None = 6) -> str:
    """SELECT of the four rates and sample_size, per group if any."""
    flags = flag_sql(src, measured, numeric, rules, group)
    w = "1.0::DOUBLE" if weight is None else weight
    total = f"sum({w})" if weight is None else f"(sum({w}) + 1e-12)"

    def rate(x):
        value = f"coalesce(sum({w} * {x}) / {total}, 0.0)"
        return value if digits is None else f"round({value}, {digits})"

    def flag(c):
        return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"

    keys = ", ".join(group)
    return (f"SELECT {keys + ', ' if group else ''}{rate(f'(null_cells / {len(measured)}.0::DOUBLE)')} AS missing_rate, "
            f"{rate(flag('is_duplicate'))} AS duplicate_rate, {rate(flag('is_outlier'))} AS outlier_rate, "
            f"{rate(flag('is_inconsistent'))} AS inconsistency_rate, CAST(count(*) AS BIGINT) AS sample_size "
            f"FROM ({flags}) t" + (f" GROUP BY {keys}" if group else ""))


def score_sql(numeric: Sequence[str], s: str = "s", f: str = "f") -> tuple[str, str]:
    """(outlying cells, missing cells) of a row against proxy fences ``f``."""
    o = " + ".join(f"CASE WHEN coalesce({s}.{c} < {f}.low_{i} OR {s}.{c} > {f}.high_{i}, FALSE) THEN 1 ELSE 0 END" for i, c in enumerate(numeric))
    m = " + ".join(f"CASE WHEN {s}.{c} IS NULL THEN 1 ELSE 0 END" for c in numeric)
    return o, m


# ---- the dirtied line items ----------------------------------------------------------------------------------------

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEASURED = [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
DIRTY_KEY = [*LINE_KEY, "copy_no"]
LINE_RULES = [(("l_shipdate", "l_quantity"), "l_discount")]
SEED, MISSING_RATE, OUTLIER_RATE, COPY_RATE = 7, 0.05, 0.05, 0.02
_written: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], write: bool = True) -> DataFrame:
    """A derived table written once per session and source folder (``write=False``: it reads written tables only)."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _written:
        _written[key] = materialise(build(), name) if write else build()
    return _written[key]


def dirty_lines(spark: SparkSession, folder: str, rules=LINE_RULES) -> AuditTable:
    """lineitem with missing cells, shifted outliers and repeated rows."""
    def damaged():
        clean = spread(load(spark, folder, "lineitem"))
        dirty = inject.inject_missing(clean, MISSING_RATE, LINE_KEY, MEASURED, SEED, mode="bernoulli")
        return inject.inject_outliers(dirty, OUTLIER_RATE, LINE_KEY, NUMBERS, SEED, clean=clean)

    def build():
        return inject.inject_duplicates(once(spark, folder, "damaged_lines", damaged), COPY_RATE, LINE_KEY, SEED)

    return audit(once(spark, folder, "dirty_lines", build, write=False), DIRTY_KEY, MEASURED, rules, "dirty_lines")


def copies_sql(src: str, source: str, keys: Sequence[str], columns: Sequence[str], rate: float, seed: int, depth: int = 6) -> str:
    """src plus int(n rate) copies of ``source`` rows: the first arrivals of one Poisson process per row."""
    times = [" + ".join(expo(seed, f"copy{j}", *keys) for j in range(1, n + 1)) for n in range(1, depth + 1)]
    arrivals = " UNION ALL ".join(f"SELECT *, {t} AS arrival, {n} AS copy_no FROM {source}" for n, t in enumerate(times, start=1))
    cols = ", ".join([*keys, *columns])
    return (f"SELECT {cols}, 0 AS copy_no FROM {src} UNION ALL SELECT {cols}, copy_no FROM (SELECT *, row_number() OVER "
            f"(ORDER BY arrival, {', '.join(keys)}, copy_no) AS rn FROM ({arrivals}) a) r "
            f"WHERE rn <= (SELECT {integer_part('count(*)', rate)} FROM {source})")


def outlier_sql(src: str, keys, numeric, others, rate, seed, clean: str) -> str:
    share = d(-math.expm1(-rate / len(numeric)))
    moved = [f"CASE WHEN {u(seed, f'outlier:{c}', *keys)} < {share} THEN s.{c} + {sign(seed, f'sign:{c}', *keys)} * 10.0 * (x.sd_{c} + 1e-6) ELSE s.{c} END AS {c}"
             for c in numeric]
    sds = ", ".join(f"stddev_samp({c}) AS sd_{c}" for c in numeric)
    return f"SELECT {', '.join([*[f's.{k}' for k in keys], *moved, *[f's.{c}' for c in others]])} FROM {src} s CROSS JOIN (SELECT {sds} FROM {clean}) x"


def missing_sql(src: str, keys, columns, share: float, seed, others=()) -> str:
    cells = [f"CASE WHEN {u(seed, f'missing:{c}', *keys)} >= {d(share)} THEN {c} END AS {c}" for c in columns]
    return f"SELECT {', '.join([*keys, *others, *cells])} FROM {src}"


DIRTY_CTE = (
    f"missing_lines AS ({missing_sql('lineitem', LINE_KEY, MEASURED, MISSING_RATE, SEED)}), "
    f"damaged_lines AS ({outlier_sql('missing_lines', LINE_KEY, NUMBERS, MEASURED[4:], OUTLIER_RATE, SEED, 'lineitem')}), "
    f"dirty_lines AS MATERIALIZED ({copies_sql('damaged_lines', 'damaged_lines', LINE_KEY, MEASURED, COPY_RATE, SEED)})"
)
_O, _M = score_sql(NUMBERS)
SCORED_CTE = (
    f"proxy AS ({fence_sql('dirty_lines', NUMBERS, 'proxy')}), "
    f"scored AS MATERIALIZED (SELECT s.*, ({_O}) AS o, ({_M}) AS m, ({_O}) / 4.0::DOUBLE + ({_M}) / 4.0::DOUBLE AS score FROM dirty_lines s CROSS JOIN proxy f)"
)
