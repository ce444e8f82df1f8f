"""Exact linearly interpolated quantiles that do not pass through one reducer, for any number of rows and groups.

``percentile`` is exact but merges one value->count map per group in a single task.  Here every wanted order statistic is a
*target*, a row (group, column, rank, interval, rows in it, rows below it).  A pass counts the rows of all open intervals
in bins (map-side combined) and narrows each target to the bin that holds its rank, down to the least and largest value met
there; an interval of few rows is counted by value, which settles it.  The targets are a table like any other: they are joined to
the rows and to the bins, lie in storage between passes, and never come to the driver.
"""
from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double
from .storage import materialise

BINS = 2048
SMALL_BIN = 1_000_000  # an interval of at most so many rows is counted by value
LARGEST = sys.float_info.max


def quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """One row per group with an array column per input column (``NULL`` for an all-null column).

    ``rows`` is a known upper bound on the size of ``df``: if no interval can hold more than SMALL_BIN rows, one pass settles
    every target, so none has to be stored and looked at.
    """
    names = {g: f"g_{k}" for k, g in enumerate(group)}
    named = df.select(*[F.col(f"`{g}`").alias(n) for g, n in names.items()], *[as_double(c).alias(f"v_{k}") for k, c in enumerate(columns)])
    cells = named.select(*names.values(), F.explode(F.array(*[
        F.struct(F.lit(k).alias("i"), F.col(f"v_{k}").alias("v")) for k in range(len(columns))])).alias("cell")).select(*names.values(), "cell.i", "cell.v")
    by = [*names.values(), "i"]
    targets = _targets(named, list(names.values()), len(columns), probs)
    if rows is not None and rows <= SMALL_BIN:
        targets = _narrowed(cells, targets, by)
    else:
        targets = materialise(targets, "targets")
        while not targets.where(OPEN).isEmpty():
            targets = materialise(_narrowed(cells, targets, by), "targets")
    return interpolated(targets, by, columns, probs).withColumnsRenamed({n: g for g, n in names.items()})


OPEN = "coalesce(lo != hi, false)"


def _targets(named: DataFrame, group: Sequence[str], n_columns: int, probs: Sequence[float]) -> DataFrame:
    """The ranks wanted of every group and column, each with the whole range as its interval; columns are summed up side by side, not as cells."""
    sums = [f(f"v_{k}").alias(f"{name}_{k}") for k in range(n_columns) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    listed = F.array(*[F.struct(F.lit(k).alias("i"), *[F.col(f"{c}_{k}").alias(c) for c in ("n", "lo", "hi")]) for k in range(n_columns)])
    by = [*group, "i"]
    whole = named.groupBy(*group).agg(*sums).select(*group, F.inline(listed))
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: (F.col("n") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))
    wanted = whole.select(*by, F.col("n").alias("total"), "lo", "hi", "n", F.lit(0).cast("bigint").alias("below"), F.explode(ranks).alias("rank"))
    return wanted.withColumn("rank", F.when(F.col("n") > 0, F.col("rank")))


def _same(columns: Sequence[str], names: dict[str, str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(names[c])) for c in columns])


def _narrowed(cells: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every open target with the bin of its interval that holds its rank as its new interval."""
    open_ = targets.where(OPEN)
    names = {c: f"t_{c}" for c in by}
    intervals = open_.select(*[F.col(c).alias(names[c]) for c in by], "lo", "hi", (F.col("n") <= SMALL_BIN).alias("small")).distinct()
    inside = cells.join(intervals, _same(by, names)).where("v >= lo and v <= hi").drop(*names.values())
    # few rows split by value, many into equal widths of their own range (halved: no overflow)
    v, low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) / 2.0 for c in ("v", "lo", "hi"))
    position = F.coalesce(F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * BINS), F.lit(BINS - 1)), F.lit(0))
    bins = inside.groupBy(*by, "lo", "hi", F.when(~F.col("small"), position.cast("double")).otherwise(F.col("v")).alias("bin")).agg(
        F.count("v").alias("held"), F.min("v").alias("least"), F.max("v").alias("largest"))
    before = Window.partitionBy(*by, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("bin").withColumnsRenamed({c: f"t_{c}" for c in [*by, "lo", "hi"]})
    here = _same([*by, "lo", "hi"], {c: f"t_{c}" for c in [*by, "lo", "hi"]})
    rank = F.col("rank") - F.col("below")
    found = open_.join(placed, here & (rank >= F.col("before")) & (rank < F.col("before") + F.col("held")))
    moved = found.select(*by, "total", F.col("least").alias("lo"), F.col("largest").alias("hi"), F.col("held").alias("n"), (F.col("below") + F.col("before")).alias("below"), "rank")
    return targets.where(f"not {OPEN}").unionByName(moved)


def interpolated(targets: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """An array of quantiles per group and column from the settled targets (at most two a quantile)."""
    known = F.map_from_entries(F.filter(F.collect_list(F.struct("rank", "lo")), lambda t: t["rank"].isNotNull()))
    settled = targets.groupBy(*by).agg(F.first("total").alias("total"), known.alias("known"))
    out = []
    for p in probs:
        at = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.element_at("known", F.floor(at)), F.element_at("known", F.ceil(at))
        # as percentile() does: weights from the neighbouring ranks
        out.append(F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high))
    arrays = settled.select(*by, F.when(F.col("total") > 0, F.array(*out)).alias("q"))
    return arrays.groupBy(*by[:-1]).agg(*[F.max(F.when(F.col("i") == k, F.col("q"))).alias(c) for k, c in enumerate(columns)])


# ---- quantiles of variants of a table ------------------------------------------------------------------------------

FEW = 65536  # an interval of so many rows is counted by value, once per variant


def variant_quantiles(base: DataFrame, delta: DataFrame, variants: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of many variants of tables that are given once: (variant, one array per column).

    ``base`` holds (part, columns), ``variants`` (variant, part), ``delta`` the rows a variant loses (``sign`` -1) and gains
    (+1): (variant, sign, columns).  A rank is found in the signed sum of both counts.  Rows of ``base`` are counted once per
    distinct interval, however many variants look into it; only bins are multiplied by variants.
    """
    def cells(df, *kept):
        values = F.array(*[F.struct(F.lit(k).alias("i"), as_double(c).alias("v")) for k, c in enumerate(columns)])
        return df.select(*kept, F.explode(values).alias("cell")).select(*kept, "cell.i", "cell.v").where("v is not null")

    fixed, moved = cells(base, "part"), cells(delta, "variant", "sign")
    whole = fixed.groupBy("part", "i").agg(F.count("v").alias("n_base"), F.min("v").alias("lo_base"), F.max("v").alias("hi_base"))
    change = moved.groupBy("variant", "i").agg(F.sum("sign").alias("n_moved"), F.count("v").alias("held_moved"), F.min("v").alias("lo_moved"), F.max("v").alias("hi_moved"))
    listed = variants.select("variant", "part", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("i"))
    all_ = listed.join(whole, ["part", "i"], "left").join(change, ["variant", "i"], "left").na.fill(0, ["n_base", "n_moved", "held_moved"])
    total = (F.col("n_base") + F.col("n_moved")).alias("total")
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: (F.col("total") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))
    targets = all_.select("variant", "part", "i", total, F.least("lo_base", "lo_moved").alias("lo"), F.greatest("hi_base", "hi_moved").alias("hi"),
                          (F.col("n_base") + F.col("held_moved")).alias("n"), F.lit(0).cast("bigint").alias("below"))
    targets = targets.withColumn("rank", F.explode(ranks)).withColumn("rank", F.when(F.col("total") > 0, F.col("rank")))
    targets = targets.withColumns({c: F.when(F.col("total") > 0, F.col(c)) for c in ("lo", "hi")})
    targets = materialise(targets, "targets")
    while not targets.where(OPEN).isEmpty():
        targets = materialise(_narrowed_variants(fixed, moved, targets), "targets")
    return interpolated(targets, ["variant", "i"], columns, probs)


def _narrowed_variants(fixed: DataFrame, moved: DataFrame, targets: DataFrame) -> DataFrame:
    open_ = targets.where(OPEN).withColumn("few", F.col("n") <= FEW)
    asked = ["i", "lo", "hi", "few"]
    v, low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) / 2.0 for c in ("v", "lo", "hi"))
    position = F.coalesce(F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * BINS), F.lit(BINS - 1)), F.lit(0))
    bin_ = F.when(~F.col("few"), position.cast("double")).otherwise(F.col("v")).alias("bin")

    def binned(rows, owner, net):
        intervals = open_.select(owner, *asked).distinct()
        inside = rows.join(F.broadcast(intervals), [owner, "i"]).where("v >= lo and v <= hi")  # at most 2 intervals a quantile of a variant
        return inside.groupBy(owner, *asked, bin_).agg(net.alias("net"), F.count("v").alias("held"), F.min("v").alias("least"), F.max("v").alias("largest"))

    ours = open_.select("variant", "part", *asked).distinct()
    shared = ours.join(binned(fixed, "part", F.count("v")), ["part", *asked]).drop("part")
    own = binned(moved, "variant", F.sum("sign"))
    bins = shared.unionByName(own).groupBy("variant", *asked, "bin").agg(
        *[F.sum(c).alias(c) for c in ("net", "held")], F.min("least").alias("least"), F.max("largest").alias("largest"))
    before = Window.partitionBy("variant", *asked).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("before", F.coalesce(F.sum("net").over(before), F.lit(0)))
    rank = F.col("rank") - F.col("below")
    found = open_.drop("n").join(placed, ["variant", *asked]).where((rank >= F.col("before")) & (rank < F.col("before") + F.col("net")))
    kept = found.select("variant", "part", "i", "total", F.col("least").alias("lo"), F.col("largest").alias("hi"), F.col("held").alias("n"),
                        (F.col("below") + F.col("before")).alias("below"), "rank")
    return targets.where(f"not {OPEN}").unionByName(kept)
