"""Profiles of nested samples: each row is read once and counts from the first sample that holds it on.

Samples that are prefixes of one draw order contain each other, so a row needs only its *level*, the number of the smallest
sample that holds it.  Counts per level are added up along the levels; a content is repeated from the level of its second row
on, a determinant is broken from the level at which a second dependent appears.  Nothing is multiplied by the number of
samples but bins, fences and the few rows that lie outside the narrowest fences.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, nan_to_null, numeric_columns
from .profile import DUPLICATE, INCONSISTENCY, INDICATORS, MISSING, OUTLIER, any_of, count_nulls, dependent_hash, fence_columns, known, outside
from .quantiles import BINS, LARGEST, OPEN, interpolated
from .storage import materialise
from .table import fd_rules, row_hashes

FEW = 16_384  # an interval of so many rows is counted by value
ROWS_PER_TASK = 250_000


def nested_profile(rows: DataFrame, steps: int, measured: Sequence[str], rules=(), group: str = "seed", held: int = 0) -> DataFrame:
    """``(group, step, indicators, sample_size)`` of the rows with ``level`` <= step, for the steps 0 .. ``steps`` - 1 that have rows.

    ``rows`` holds (group, level, measured columns); ``held`` is their number, which sets the number of tasks.
    """
    rows, measured, tasks = nan_to_null(rows), list(measured), max(1, math.ceil(held / ROWS_PER_TASK))
    usable = [r for r in fd_rules(rules) if {*r.determinant, r.dependent} <= set(measured)]
    numeric = numeric_columns(rows, measured)
    plain = rows.groupBy(group, "level").agg(F.count(F.lit(1)).alias("n"), F.sum(count_nulls(measured)).alias("nulls"))
    changes = [plain, *_repeated_and_broken(rows, measured, usable, group, tasks)]
    summed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)
    for c in ("n", "nulls", "repeated", "broken"):
        if c not in summed.columns:
            summed = summed.withColumn(c, F.lit(None).cast("bigint"))
    grid = rows.select(group).distinct().crossJoin(F.broadcast(_steps(rows, steps)))
    total = _running(grid.join(summed.groupBy(group, F.col("level").alias("step")).agg(
        *[F.sum(c).alias(c) for c in ("n", "nulls", "repeated", "broken")]), [group, "step"], "left"), group, ["n", "nulls", "repeated", "broken"])
    if numeric:
        total = total.join(_outlying(rows, numeric, steps, group), [group, "step"], "left")
    else:
        total = total.withColumn("out", F.lit(0))

    def rate(numerator: str, per: int = 1) -> Column:
        return F.coalesce(F.col(numerator).cast("double") / F.nullif(F.col("n") * F.lit(per), F.lit(0)), F.lit(0.0))

    rates = {MISSING: rate("nulls", max(len(measured), 1)), DUPLICATE: rate("repeated"), OUTLIER: rate("out"), INCONSISTENCY: rate("broken")}
    return total.where("n > 0").select(group, "step", *[rates[i].alias(i) for i in INDICATORS], F.col("n").cast("bigint").alias("sample_size"))


def _steps(df: DataFrame, steps: int) -> DataFrame:
    return df.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))


def _running(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    so_far = Window.partitionBy(group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.sum(c).over(so_far), F.lit(0)) for c in columns})


def _repeated_and_broken(rows: DataFrame, measured: Sequence[str], rules, group: str, tasks: int) -> list[DataFrame]:
    """Changes per (group, level) of the numbers of repeated rows and of rows with a broken determinant."""
    h1, h2 = row_hashes(rows, measured)
    content = {"id_1": h1, "id_2": h2}
    determinants = list(dict.fromkeys(r.determinant for r in rules))
    for k, det in enumerate(determinants):  # null if unknown, as such determinants break nothing
        for j, h in enumerate(row_hashes(rows, det)):
            content[f"det_{k}_{j}"] = F.when(known(det), h)
    deps = [[f"dep_{k}_{j}" for j, r in enumerate(r for r in rules if r.determinant == det)] for k, det in enumerate(determinants)]
    for k, det in enumerate(determinants):
        for name, r in zip(deps[k], [r for r in rules if r.determinant == det]):
            content[name] = dependent_hash(rows, r)
    contents = rows.select(group, "level", *[c.alias(n) for n, c in content.items()]).groupBy(group, *content, "level").agg(F.count(F.lit(1)).alias("n"))

    ids = [group, "id_1", "id_2"]
    so_far = Window.partitionBy(*ids).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    seen = contents.repartition(tasks, *ids).withColumn("seen", F.sum("n").over(so_far))
    repeated = F.when(F.col("seen") < 2, 0).when(F.col("seen") - F.col("n") < 2, F.col("seen")).otherwise(F.col("n"))
    seen = seen.withColumn("repeated", repeated).drop("seen")
    if len(determinants) == 1:
        whole = _clashes(seen, group, 0, deps[0], tasks, repeated=True)
        before = F.col("clashed_before")
        broken = F.when(~F.col("clashed") | F.col("det_0_0").isNull(), 0).when(before, F.col("n")).otherwise(F.col("so_far"))
        return [whole.groupBy(group, "level").agg(F.sum("repeated").alias("repeated"), F.sum(broken).alias("broken"))]
    out = [seen.groupBy(group, "level").agg(F.sum("repeated").alias("repeated"))]
    if determinants:
        marked = contents
        for k, names in enumerate(deps):
            clash = _clashes(contents.where(F.col(f"det_{k}_0").isNotNull()), group, k, names, tasks).where("clashed").groupBy(
                group, f"det_{k}_0", f"det_{k}_1").agg(F.min("level").alias(f"clash_{k}"))
            marked = marked.join(clash, [group, f"det_{k}_0", f"det_{k}_1"], "left")
        first = F.least(*[F.col(f"clash_{k}") for k in range(len(deps))])  # skips nulls
        out.append(marked.where(first.isNotNull()).groupBy(group, F.greatest("level", first).alias("level")).agg(F.sum("n").alias("broken")))
    return out


def _clashes(contents: DataFrame, group: str, k: int, deps: Sequence[str], tasks: int, repeated: bool = False) -> DataFrame:
    """Rows per determinant and level, those up to the level, and whether two dependents have met up to it, and before it."""
    det = [group, f"det_{k}_0", f"det_{k}_1"]
    sums = [F.sum("n").alias("n"), *([F.sum("repeated").alias("repeated")] if repeated else [])]
    levels = contents.groupBy(*det, "level").agg(*sums, *[a for d in deps for a in (F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}"))])
    order = Window.partitionBy(*det).orderBy("level")
    now, past = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)

    def clash(frame) -> Column:
        return F.coalesce(any_of(F.coalesce(F.min(f"min_{d}").over(frame) != F.max(f"max_{d}").over(frame), F.lit(False)) for d in deps), F.lit(False))

    return levels.repartition(tasks, *det).withColumns({"so_far": F.sum("n").over(now), "clashed": clash(now), "clashed_before": clash(past)})


# ---- outliers ------------------------------------------------------------------------------------------------------

def _outlying(rows: DataFrame, numeric: Sequence[str], steps: int, group: str) -> DataFrame:
    """(group, step, out): rows outside the fences of their step."""
    fences = materialise(nested_fences(rows, numeric, steps, group), "fences")
    n = range(len(numeric))
    inner = fences.groupBy(group).agg(*[a for i in n for a in (F.max(f"low_{i}").alias(f"low_{i}"), F.min(f"high_{i}").alias(f"high_{i}"))])
    cells = rows.select(group, "level", *[as_double(c).alias(c) for c in numeric])
    near = cells.join(F.broadcast(inner), group).where(any_of(outside(numeric))).select(*cells.columns)
    tried = near.withColumn("step", F.explode(F.sequence(F.col("level"), F.lit(steps - 1)))).join(F.broadcast(fences), [group, "step"])
    return tried.where(any_of(outside(numeric))).groupBy(group, "step").agg(F.count(F.lit(1)).alias("out"))


def nested_fences(rows: DataFrame, columns: Sequence[str], steps: int, group: str = "seed", z: float = 3.0) -> DataFrame:
    """``low_i``/``high_i`` of the rows up to every step, as ``fences`` gives them for each sample alone."""
    n = range(len(columns))
    centre = rows.groupBy(group).agg(*[F.coalesce(F.avg(as_double(c)), F.lit(0.0)).alias(f"mid_{i}") for i, c in enumerate(columns)])
    sums = []
    for i, c in enumerate(columns):
        off = as_double(c) - F.col(f"mid_{i}")  # about the mean, so that squares do not cancel
        sums += [F.count(as_double(c)).alias(f"n_{i}"), F.sum(off).alias(f"s_{i}"), F.sum(off * off).alias(f"q_{i}")]
    moments = rows.join(F.broadcast(centre), group).groupBy(group, F.col("level").alias("step")).agg(*sums)
    grid = centre.crossJoin(F.broadcast(_steps(rows, steps))).join(moments, [group, "step"], "left")
    names = [f"{m}_{i}" for i in n for m in "nsq"]
    stats = _running(grid, group, names).withColumnsRenamed({f"q_{i}": f"squares_{i}" for i in n})
    of = [F.nullif(F.col(f"n_{i}"), F.lit(0)) for i in n]
    stats = stats.withColumns({f"mean_{i}": F.col(f"mid_{i}") + F.col(f"s_{i}") / of[i] for i in n} | {
        f"sd_{i}": F.sqrt(F.greatest((F.col(f"squares_{i}") - F.col(f"s_{i}") * F.col(f"s_{i}") / of[i]) / F.nullif(F.col(f"n_{i}") - 1, F.lit(0)), F.lit(0.0))) for i in n})
    quartiles = nested_quantiles(rows, columns, (0.25, 0.75), steps, group)
    quartiles = quartiles.select(group, "step", *[F.col(f"`{c}`").alias(f"q_{i}") for i, c in enumerate(columns)])
    return stats.join(quartiles, [group, "step"], "left").select(group, "step", *fence_columns(len(columns), "profile", z))


def nested_quantiles(rows: DataFrame, columns: Sequence[str], probs: Sequence[float], steps: int, group: str = "seed") -> DataFrame:
    """Exact quantiles of the rows up to every step: (group, step, one array per column).

    Rows are counted once per level and bin, however many steps look into the bin; a rank of a step is found among the counts of the
    levels up to it.
    """
    cells = rows.select(group, "level", F.explode(F.array(*[
        F.struct(F.lit(k).alias("i"), as_double(c).alias("v")) for k, c in enumerate(columns)])).alias("cell")).select(group, "level", "cell.i", "cell.v").where("v is not null")
    by = [group, "i"]
    counts = cells.groupBy(*by, "level").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    whole = counts.groupBy(*by).agg(F.collect_list(F.struct("level", "n")).alias("levels"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]), lambda p: (F.col("total") - 1) * p)
    ranks = F.array_distinct(F.concat(F.transform(at, lambda x: F.floor(x)), F.transform(at, lambda x: F.ceil(x))))
    each = whole.crossJoin(F.broadcast(_steps(rows, steps))).withColumn("total", _up_to_step("n")).where("total > 0")
    targets = each.select(*by, "step", "total", "lo", "hi", "n", F.lit(0).cast("bigint").alias("below"), F.explode(ranks).alias("rank"))
    targets = materialise(targets, "targets")
    while not targets.where(OPEN).isEmpty():
        targets = materialise(_narrowed(cells, targets, by), "targets")
    return interpolated(targets, [group, "step", "i"], columns, probs)


def _up_to_step(value: str) -> Column:
    step = F.col("step")
    return F.aggregate(F.filter("levels", lambda x: x["level"] <= step), F.lit(0).cast("bigint"), lambda a, x: a + x[value])


def _narrowed(cells: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    open_ = targets.where(OPEN).withColumn("few", F.col("n") <= FEW)
    asked = [*by, "lo", "hi", "few"]
    v, low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) / 2.0 for c in ("v", "lo", "hi"))
    position = F.coalesce(F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * BINS), F.lit(BINS - 1)), F.lit(0))
    bin_ = F.when(~F.col("few"), position.cast("double")).otherwise(F.col("v")).alias("bin")
    intervals = open_.select(*asked).distinct()  # at most four a step and column
    inside = cells.join(F.broadcast(intervals), list(by)).where("v >= lo and v <= hi")
    levels = inside.groupBy(*asked, bin_, "level").agg(F.count("v").alias("held"), F.min("v").alias("least"), F.max("v").alias("largest"))
    bins = levels.groupBy(*asked, "bin").agg(F.collect_list(F.struct("level", "held")).alias("levels"), F.sum("held").alias("n"),
                                             F.min("least").alias("least"), F.max("largest").alias("largest"))
    placed = bins.join(F.broadcast(open_.select(*asked, "step").distinct()), asked).withColumn("held", _up_to_step("held")).drop("levels").where("held > 0")
    before = Window.partitionBy(*asked, "step").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("before", F.sum("held").over(before) - F.col("held"))
    rank = F.col("rank") - F.col("below")
    found = placed.join(F.broadcast(open_.drop("n")), [*asked, "step"]).where((rank >= F.col("before")) & (rank < F.col("before") + F.col("held")))
    kept = found.select(*by, "step", "total", F.col("least").alias("lo"), F.col("largest").alias("hi"), "n", (F.col("below") + F.col("before")).alias("below"), "rank")
    return targets.where(f"not {OPEN}").unionByName(kept)
