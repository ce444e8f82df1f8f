"""Quality profile: missing, duplicate, outlier and inconsistency rates, plain, weighted or per group.

Only the indicators asked for are computed.  Plan of a full profile: a small statistics row (fences) is broadcast; every
row is then reduced to a few integers and grouped by its 128-bit content hash, which yields the missing, outlier and duplicate sums at once; with one
determinant the hash groups are grouped again by determinant for the dependency check.  One scan, no join, and both
groupings combine map-side, so a hot row or a hot determinant costs no more than any other.
"""
from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, nan_to_null, numeric_columns
from .quantiles import quantile_table
from .storage import materialise
from .table import AuditTable, FdRule, fd_rules, row_hashes

MISSING, DUPLICATE, OUTLIER, INCONSISTENCY = INDICATORS = (
    "missing_rate", "duplicate_rate", "outlier_rate", "inconsistency_rate")
HEAVY_SHARE = 256  # a key with more than 1/256 of the rows is heavy; there can be at most 255 of them


# ---- fences --------------------------------------------------------------------------------------------------------

def fences(df: DataFrame, columns: Sequence[str], rule: str = "profile", group: Sequence[str] = (),
           rows: int | None = None, z: float = 3.0) -> DataFrame:
    """One row per group with ``low_i``/``high_i`` per column: a value outside them is an outlier.

    Tukey fences q1 - 1.5 iqr and q3 + 1.5 iqr.  A column with iqr 0 falls back to mean +- z sd, except under
    ``rule="tukey"`` (no fallback).  ``rule="profile"`` uses the sample sd and skips columns with fewer than four
    values; ``rule="proxy"`` uses the population sd and skips none.
    """
    if not columns:
        raise ValueError("no numeric column")
    sd = F.stddev_samp if rule == "profile" else F.stddev_pop
    moments = []
    for i, c in enumerate(columns):
        moments += [F.count(as_double(c)).alias(f"n_{i}"), F.avg(as_double(c)).alias(f"mean_{i}"), sd(as_double(c)).alias(f"sd_{i}")]
    stats = df.groupBy(*group).agg(*moments) if group else df.agg(*moments)
    quartiles = quantile_table(df, columns, (0.25, 0.75), group, df.count() if rows is None else rows)
    stats = _attach(stats, quartiles.select(*group, *[F.col(f"`{c}`").alias(f"q_{i}") for i, c in enumerate(columns)]), group)
    return stats.select(*group, *fence_columns(len(columns), rule, z))


def table_fences(t: AuditTable, rule: str = "profile") -> DataFrame:
    """:func:`fences` of the numeric columns of a table.  Counts, moments and quartiles are found once per table and serve every rule."""
    columns = t.numeric
    stored = vars(t).get("_moments")
    if stored is None:
        moments = []
        for i, c in enumerate(columns):
            x = as_double(c)
            moments += [F.count(x).alias(f"n_{i}"), F.avg(x).alias(f"mean_{i}"), F.stddev_samp(x).alias(f"samp_{i}"), F.stddev_pop(x).alias(f"pop_{i}")]
        quartiles = quantile_table(t.df, columns, (0.25, 0.75), rows=t.rows)
        stats = t.df.agg(*moments).crossJoin(F.broadcast(quartiles.select(*[F.col(f"`{c}`").alias(f"q_{i}") for i, c in enumerate(columns)])))
        stored = vars(t)["_moments"] = materialise(stats, "moments")
    sd = "samp" if rule == "profile" else "pop"
    return stored.withColumns({f"sd_{i}": F.col(f"{sd}_{i}") for i in range(len(columns))}).select(*fence_columns(len(columns), rule))


def fence_columns(n_columns: int, rule: str = "profile", z: float = 3.0) -> list[Column]:
    """``low_i``/``high_i`` from quartiles ``q_i``, counts ``n_i``, means ``mean_i`` and deviations ``sd_i``."""
    out = []
    for i in range(n_columns):
        q1, q3 = F.get(f"q_{i}", F.lit(0)), F.get(f"q_{i}", F.lit(1))
        iqr = q3 - q1
        low, high = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        if rule == "tukey":
            low, high = F.when(iqr > 0, low), F.when(iqr > 0, high)
        else:
            reach = F.lit(z) * (F.coalesce(F.col(f"sd_{i}"), F.lit(0.0)) + 1e-9)
            low = F.when(iqr == 0, F.col(f"mean_{i}") - reach).otherwise(low)
            high = F.when(iqr == 0, F.col(f"mean_{i}") + reach).otherwise(high)
        if rule == "profile":
            low, high = F.when(F.col(f"n_{i}") >= 4, low), F.when(F.col(f"n_{i}") >= 4, high)
        out += [low.alias(f"low_{i}"), high.alias(f"high_{i}")]
    return out


def _attach(df: DataFrame, small: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join a table of one row per group (one row without groups); a NULL group is a group like any other.

    The number of groups has no bound here, so Spark chooses the join by the size it sees.
    """
    if not group:
        return df.crossJoin(F.broadcast(small))
    names = {g: f"group_{i}" for i, g in enumerate(group)}
    same = reduce(lambda a, b: a & b, [F.col(f"`{g}`").eqNullSafe(F.col(n)) for g, n in names.items()])
    return df.join(small.withColumnsRenamed(names), same).drop(*names.values())


def outside(columns: Sequence[str]) -> list[Column]:
    """Outlier flag of each cell, against the fences joined to the row; never null."""
    return [F.coalesce((as_double(c) < F.col(f"low_{i}")) | (as_double(c) > F.col(f"high_{i}")), F.lit(False))
            for i, c in enumerate(columns)]


def any_of(flags: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def count_nulls(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in columns], F.lit(0))


# ---- the profile ---------------------------------------------------------------------------------------------------

def profile(
    df: DataFrame,
    measured: Sequence[str] | None = None,
    rules=(),
    weight: str | None = None,
    group: Sequence[str] = (),
    rows: int | None = None,
    z: float = 3.0,
    exact_rows: bool = False,
    indicators: Sequence[str] = INDICATORS,
    bounds: DataFrame | None = None,
    apart: bool = False,
) -> DataFrame:
    """The rates asked for and ``sample_size`` of ``df``, in one row, or in one row per ``group``.

    ``weight`` makes them weighted means; fences stay unweighted.  ``exact_rows`` groups by the columns themselves
    instead of their hash.  ``bounds`` are the fences if they are known.  ``apart`` reads the rows once more for
    the dependency (rules of one determinant, no ``group``), so that contents and determinants do not travel together: less is shuffled.  NaN counts as missing.  Only what ``indicators`` need is computed: missing and outlier
    rates shuffle no row.
    """
    df, group, wanted = nan_to_null(df), list(group), [i for i in INDICATORS if i in set(indicators)]
    measured = [c for c in df.columns if c not in group and c != weight] if measured is None else list(measured)
    rules = rules if INCONSISTENCY in wanted else ()
    usable = tuple(r for r in fd_rules(rules) if {*r.determinant, r.dependent} <= set(measured))
    numeric = numeric_columns(df, measured) if OUTLIER in wanted else []
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("double")

    rowwise = df
    if numeric:
        rowwise = _attach(df, fences(df, numeric, "profile", group, rows, z) if bounds is None else bounds, group)
    determinants = list(dict.fromkeys(r.determinant for r in usable))

    h1, h2 = row_hashes(df, measured)
    identity = {f"id_{i}": F.col(f"`{c}`") for i, c in enumerate(measured)} if exact_rows else {"id_1": h1, "id_2": h2}
    if DUPLICATE not in wanted:
        identity = {}
    one = usable if len(determinants) == 1 else ()
    alone = one if apart and not group else ()
    one = () if alone else one
    det, dep = {}, {}
    if one and exact_rows:
        det = {f"det_{i}": F.col(f"`{c}`") for i, c in enumerate(determinants[0])} | {"det_known": known(determinants[0])}
        dep = {f"dep_{i}": F.col(f"`{r.dependent}`") for i, r in enumerate(one)}
    elif one:  # long texts stay out of the shuffles: determinants and dependents travel as hashes
        d1, d2 = row_hashes(df, determinants[0])
        det = {"det_1": d1, "det_2": d2, "det_known": known(determinants[0])}
        dep = {f"dep_{i}": dependent_hash(df, r) for i, r in enumerate(one)}
    reduced = rowwise.select(
        *group, *[c.alias(a) for a, c in {**identity, **det, **dep}.items()], w.alias("w"),
        count_nulls(measured).alias("nulls"), any_of(outside(numeric)).cast("int").alias("out"), F.lit(0).alias("broken"))
    weighed = {c: F.col("w") * F.col(c) for c in ("nulls", "out", "broken")}
    if identity or det:
        contents = reduced.groupBy(*group, *identity, *det, *dep).agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), *[F.sum(c).alias(name) for name, c in weighed.items()])
    else:
        contents = reduced.withColumns({**weighed, "n": F.lit(1).cast("bigint")})
    sums = [F.sum(c).alias(c) for c in ("n", "w", "nulls", "out")]
    repeated = F.sum(F.when(F.col("n") > 1, F.col("w"))).alias("repeated")
    if one:
        clash = any_of(F.min(d) != F.max(d) for d in dep)
        contents = contents.groupBy(*group, *det).agg(*sums, repeated, F.coalesce(clash, F.lit(False)).alias("clash"))
        contents = contents.withColumn("broken", F.when(F.col("clash") & F.col("det_known"), F.col("w")))
        totals = [*sums, F.sum("repeated").alias("repeated"), F.sum("broken").alias("broken")]
    else:
        totals = [*sums, repeated, F.sum("broken").alias("broken")]
    total = contents.groupBy(*group).agg(*totals) if group else contents.agg(*totals)
    if len(determinants) > 1:
        total = _attach(total.drop("broken"), _broken_weight(df, usable, group, w), group)
    if alone:
        total = _attach(total.drop("broken"), _broken_apart(df, alone, w), ())

    weight_sum = F.col("w") if weight is None else F.col("w") + 1e-12

    def rate(numerator: str, per: int = 1) -> Column:
        return F.coalesce(F.col(numerator).cast("double") / F.nullif(weight_sum * F.lit(per), F.lit(0)), F.lit(0.0))

    rates = {MISSING: rate("nulls", max(len(measured), 1)), DUPLICATE: rate("repeated"), OUTLIER: rate("out"), INCONSISTENCY: rate("broken")}
    return total.select(*group, *[rates[i].alias(i) for i in wanted], F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("sample_size"))


def _broken_apart(df: DataFrame, rules: Sequence[FdRule], w: Column) -> DataFrame:
    """Weight of the rows that break a rule, for rules that share a determinant: rows are grouped by it, which combines map-side."""
    d1, d2 = row_hashes(df, rules[0].determinant)
    dep = {f"dep_{i}": dependent_hash(df, r) for i, r in enumerate(rules)}
    clash = F.coalesce(any_of(F.min(d) != F.max(d) for d in dep), F.lit(False))
    rows = df.where(known(rules[0].determinant)).select(d1.alias("det_1"), d2.alias("det_2"), *[c.alias(d) for d, c in dep.items()], w.alias("w"))
    return rows.groupBy("det_1", "det_2").agg(F.sum("w").alias("w"), clash.alias("clash")).agg(F.sum(F.when(F.col("clash"), F.col("w"))).alias("broken"))


def _broken_weight(df: DataFrame, rules: Sequence[FdRule], group: Sequence[str], w: Column) -> DataFrame:
    """Weight of the rows that break a rule, per group, for rules with several determinants.

    Rows are counted by the hashes of their determinants and dependents first, which combines map-side.  The counts, not the rows, are then
    marked per determinant, and the marks of one determinant do not wait for those of another.
    """
    determinants = list(dict.fromkeys(r.determinant for r in rules))
    of = [[r for r in rules if r.determinant == det] for det in determinants]
    hashes: dict[str, Column] = {}
    for k, det in enumerate(determinants):
        hashes |= {f"det_{k}_{j}": F.when(known(det), h) for j, h in enumerate(row_hashes(df, det))}
        hashes |= {f"dep_{k}_{j}": dependent_hash(df, r) for j, r in enumerate(of[k])}
    counted = df.select(*[F.col(f"`{g}`") for g in group], *[c.alias(name) for name, c in hashes.items()], w.alias("w")).groupBy(
        *[F.col(f"`{g}`") for g in group], *hashes).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    contents = materialise(counted, "contents")  # read once per determinant and once more
    total = contents.agg(F.sum("n")).first()[0] or 0
    marked = contents
    for k, det in enumerate(determinants):
        on, deps = [f"det_{k}_0", f"det_{k}_1"], [f"dep_{k}_{j}" for j in range(len(of[k]))]
        clash = F.coalesce(any_of(F.min(d) != F.max(d) for d in deps), F.lit(False))
        keys = contents.where(F.col(on[0]).isNotNull()).groupBy(*[F.col(f"`{g}`") for g in group], *on).agg(F.sum("n").alias("n"), clash.alias("marked"))
        marked = mark_keys(marked.withColumnRenamed("n", "rows"), keys, on, f"broken_{k}", total, group, F.col(on[0]).isNotNull()).withColumnRenamed("rows", "n")
    broken = F.sum(F.when(any_of(F.col(f"broken_{k}") for k in range(len(determinants))), F.col("w"))).alias("broken")
    return marked.groupBy(*[F.col(f"`{g}`") for g in group]).agg(broken) if group else marked.agg(broken)


SLICE = 30  # samples in one grouped count


def profile_held(df: DataFrame, measured: Sequence[str], rules, held: Mapping[int, Column],
                 weights: Mapping[tuple[int, str], Column | None], label: str, tag: str, rows: int | None = None) -> DataFrame:
    """Weighted rates of many samples of ``df`` that share rows: one row per (``label``, ``tag``) that holds any.

    ``df`` are the rows that some sample holds, ``held`` says of each sample whether it holds a row; ``weights`` lists the tags of the samples and their weights (``None``: 1).
    Rows are shuffled once, with one count per sample, and not once per sample: duplicates by content, a dependency by determinant
    and dependent.  Missing and outlier rates shuffle no row.  Several rules are checked on one row per sample.  ``rows`` is the
    sum of the sizes over samples and tags, if it is known.
    """
    df, measured = nan_to_null(df), list(measured)
    usable = tuple(r for r in fd_rules(rules) if {*r.determinant, r.dependent} <= set(measured))
    tagged = [F.when(held[k], F.struct(F.lit(k).alias(label), F.lit(g).alias(tag), (F.lit(1.0) if w is None else w.cast("double")).alias("__w")))
              for (k, g), w in weights.items()]
    exploded = df.select(*[F.col(f"`{c}`") for c in measured], F.explode(F.array(*tagged)).alias("__held")).where("__held is not null")
    exploded = exploded.select(*[F.col(f"`{c}`") for c in measured], "__held.*")
    wanted = (MISSING, OUTLIER) if len(usable) == 1 or not usable else (MISSING, OUTLIER, INCONSISTENCY)
    numeric = numeric_columns(df, measured)
    # a row per sample and tag, written: its size is seen to be small, and no row is shuffled to meet its fences
    bounds = materialise(fences(exploded, numeric, "profile", [label, tag], rows), "bounds") if numeric else None
    p = profile(exploded, measured, rules, "__w", [label, tag], rows=rows, indicators=wanted, bounds=bounds)

    shares = None
    for first in range(0, len(held), SLICE):
        part = list(held)[first:first + SLICE]
        found = _shares(df, measured, usable if len(usable) == 1 else (), {k: held[k] for k in part}, {kg: w for kg, w in weights.items() if kg[0] in part}, label, tag)
        shares = found if shares is None else shares.unionByName(found)
    joined = p.join(F.broadcast(shares), [label, tag])
    rates = [F.col(i) if i in wanted or i == DUPLICATE else F.col("broken").alias(i) for i in INDICATORS]
    return joined.select(label, tag, *rates, "sample_size")


def _shares(df: DataFrame, measured: Sequence[str], rules: Sequence[FdRule], held: Mapping[int, Column],
            weights: Mapping[tuple[int, str], Column | None], label: str, tag: str) -> DataFrame:
    """Shares of duplicate rows and of rows that break the one rule, per sample and tag."""
    weighed = [(i, kg, w) for i, (kg, w) in enumerate(weights.items()) if w is not None]
    counts = [F.sum(F.col(f"in_{k}").cast("int")).alias(f"n_{k}") for k in held]
    sums = [F.sum(F.when(F.col(f"in_{k}"), F.col(f"w_{i}"))).alias(f"w_{i}") for i, (k, _), _ in weighed]

    def weight(i: int, k: int) -> Column:
        return F.col(f"w_{i}") if any(i == j for j, _, _ in weighed) else F.col(f"n_{k}").cast("double")

    def total(when, name: str) -> list[Column]:
        return [F.sum(F.when(when(k), weight(i, k))).alias(f"{name}_{i}") for i, (k, _) in enumerate(weights)]

    flags = [F.coalesce(c, F.lit(False)).alias(f"in_{k}") for k, c in held.items()] + [w.cast("double").alias(f"w_{i}") for i, _, w in weighed]
    h1, h2 = row_hashes(df, measured)
    contents = df.select(h1.alias("id_1"), h2.alias("id_2"), *flags).groupBy("id_1", "id_2").agg(*counts, *sums)
    found = contents.agg(*total(lambda k: F.lit(True), "all"), *total(lambda k: F.col(f"n_{k}") > 1, "repeated"))
    if rules:
        rule = rules[0]
        d1, d2 = row_hashes(df, rule.determinant)
        pairs = df.where(known(rule.determinant)).select(d1.alias("det_1"), d2.alias("det_2"), dependent_hash(df, rule).alias("dep"), *flags)
        pairs = pairs.groupBy("det_1", "det_2", "dep").agg(*counts, *sums)
        dets = pairs.groupBy("det_1", "det_2").agg(
            *[F.count_if(F.col("dep").isNotNull() & (F.col(f"n_{k}") > 0)).alias(f"deps_{k}") for k in held],
            *[F.sum(f"n_{k}").alias(f"n_{k}") for k in held], *[F.sum(f"w_{i}").alias(f"w_{i}") for i, _, _ in weighed])
        found = found.crossJoin(F.broadcast(dets.agg(*total(lambda k: F.col(f"deps_{k}") > 1, "broken"))))

    def rate(name: str, i: int) -> Column:
        return F.coalesce(F.col(f"{name}_{i}") / (F.col(f"all_{i}") + 1e-12), F.lit(0.0))

    return found.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias(label), F.lit(g).alias(tag), rate("repeated", i).alias(DUPLICATE), (rate("broken", i) if rules else F.lit(0.0)).alias("broken"))
        for i, (k, g) in enumerate(weights)])))


def profile_table(t: AuditTable, weight: str | None = None, n_records: int | None = None, **options) -> DataFrame:
    """Profile of an audited table or sample; ``n_records`` is the size of the table the rows came from."""
    if t.known_rows is None and t.numeric and not {"group", "z"} & set(options) and OUTLIER in options.get("indicators", INDICATORS):
        options["bounds"] = table_fences(t)  # a whole table, which samplers look at too
    p = profile(t.df, t.measured, t.rules, weight, rows=options.pop("rows", t.known_rows), **options)
    size = F.col("sample_size") if n_records is None else F.lit(n_records).cast("bigint")
    return p.withColumn("n_records", size)


# ---- skew-safe marking ---------------------------------------------------------------------------------------------

def known(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def dependent_hash(df: DataFrame, rule: FdRule) -> Column:
    """Hash of the dependent value; null if it is null."""
    return F.when(F.col(f"`{rule.dependent}`").isNotNull(), row_hashes(df, [rule.dependent])[0])


def mark_keys(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str, total: int, group: Sequence[str] = (),
              known: Column | None = None) -> DataFrame:
    """Flag the rows of ``df`` whose key is marked in ``keys(group..., on..., n, marked)``: every key and its row count.

    Heavy keys, marked or not (more than 1/HEAVY_SHARE of the rows, so fewer than HEAVY_SHARE of them), are broadcast.
    Their rows, and rows whose key is not ``known``, take a salt that finds no partner in the shuffle join of the
    rest, so they spread over all its tasks.  The salt of the keys must not be a literal: the optimizer would fold it.
    """
    names = {c: f"key_{i}" for i, c in enumerate([*group, *on])}
    keys = keys.withColumnsRenamed(names)
    heavy_key = F.col("n") * HEAVY_SHARE > total
    heavy = keys.where(heavy_key).select(*names.values(), F.col("marked").alias("heavy_mark"))
    light = keys.where(~heavy_key & F.col("marked")).select(*names.values(), F.least(F.col("n"), F.lit(0)).cast("bigint").alias("salt"), "marked")
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(n)) if c in group else F.col(f"`{c}`") == F.col(n) for c, n in names.items()])
    first = df.join(F.broadcast(heavy), same, "left").drop(*names.values())
    content = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)]
    alone = F.col("heavy_mark").isNotNull() if known is None else F.col("heavy_mark").isNotNull() | ~known
    first = first.withColumn("row_salt", F.when(alone, F.pmod(F.xxhash64(*content), F.lit(1024)) + 1).otherwise(F.lit(0)).cast("bigint"))
    second = first.join(light, same & (F.col("row_salt") == F.col("salt")), "left").drop(*names.values(), "salt", "row_salt")
    found = F.coalesce(F.col("heavy_mark"), F.lit(False)) | F.coalesce(F.col("marked"), F.lit(False))
    return second.withColumn(flag, found if known is None else found & known).drop("heavy_mark", "marked")


def mark_violations(df: DataFrame, rules, flag: str, group: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """Flag every row whose determinant is violating, rows with a null dependent included (rules share a determinant).

    Null determinants break no rule.  Determinants are compared by a 128-bit hash.
    """
    rules = fd_rules(rules)
    total = df.count() if rows is None else rows
    det = list(rules[0].determinant)
    h1, h2 = row_hashes(df, det)
    on = ["det_h1", "det_h2"]
    hashed = df.withColumns({"det_h1": h1, "det_h2": h2, "det_known": known(det)})
    dependents = {f"dep_{i}": dependent_hash(df, r) for i, r in enumerate(rules)}
    clash = F.coalesce(any_of(F.min(d) != F.max(d) for d in dependents), F.lit(False))
    keys = hashed.where("det_known").select(*group, *on, *[c.alias(d) for d, c in dependents.items()]).groupBy(*group, *on).agg(
        F.count(F.lit(1)).alias("n"), clash.alias("marked"))
    return mark_keys(hashed, keys, on, flag, total, group, F.col("det_known")).drop(*on, "det_known")


def mark_duplicates(df: DataFrame, measured: Sequence[str], flag: str = "is_duplicate", rows: int | None = None) -> DataFrame:
    """Flag the rows whose measured content occurs more than once."""
    total = df.count() if rows is None else rows
    h1, h2 = row_hashes(df, measured)
    hashed = df.withColumn("row_id_1", h1).withColumn("row_id_2", h2)
    keys = hashed.groupBy("row_id_1", "row_id_2").agg(F.count(F.lit(1)).alias("n")).withColumn("marked", F.col("n") > 1)
    return mark_keys(hashed, keys, ["row_id_1", "row_id_2"], flag, total).drop("row_id_1", "row_id_2")


def row_flags(t: AuditTable, z: float = 3.0) -> DataFrame:
    """Row-level view behind the profile: key, null cells, and the three flags."""
    df = t.df
    if t.numeric:
        df = _attach(df, fences(df, t.numeric, "profile", (), t.known_rows, z), ())
    df = df.withColumn("null_cells", count_nulls(t.measured)).withColumn("is_outlier", any_of(outside(t.numeric)))
    df = df.drop(*[f"{s}_{i}" for i in range(len(t.numeric)) for s in ("low", "high")])
    df = mark_duplicates(df, t.measured, "is_duplicate", t.rows)
    flags = []
    for i, det in enumerate(dict.fromkeys(r.determinant for r in t.rules)):
        df = mark_violations(df, [r for r in t.rules if r.determinant == det], f"broken_{i}", (), t.rows)
        flags.append(F.col(f"broken_{i}"))
    return df.select(*t.key_cols, "null_cells", "is_duplicate", "is_outlier", any_of(flags).alias("is_inconsistent"))


# ---- reading a profile ---------------------------------------------------------------------------------------------

def relative_error(estimate: DataFrame, truth: DataFrame, on: Sequence[str] = ()) -> DataFrame:
    """Bounded error per indicator, ``min(|e - t| / max(t, 0.05), 1)``, their mean, and the mean absolute difference."""
    on = list(on)
    t = truth.select(*on, *[F.col(i).alias(f"true_{i}") for i in INDICATORS])
    joined = _attach(estimate, t, on)
    gap = {i: F.abs(F.col(i) - F.col(f"true_{i}")) for i in INDICATORS}
    bounded = {i: F.least(gap[i] / F.greatest(F.col(f"true_{i}"), F.lit(0.05)), F.lit(1.0)) for i in INDICATORS}
    kept = [c for c in estimate.columns if c not in on]
    return joined.select(
        *on, *kept, *[bounded[i].alias(f"rel_err_{i}") for i in INDICATORS],
        (reduce(lambda a, b: a + b, bounded.values()) / 4).alias("rel_err_mean"),
        (reduce(lambda a, b: a + b, gap.values()) / 4).alias("rel_err_abs_mean"))


def profile_long(p: DataFrame) -> DataFrame:
    """One row per indicator: (other columns, indicator, value)."""
    others = [c for c in p.columns if c not in INDICATORS]
    return p.unpivot(others, list(INDICATORS), "indicator", "value")

