"""Progressive estimation: profiles of growing samples in one scan, their intervals, and when they settle."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Draws
from ..operators.convergence import all_converged, raftery_lewis, wald_interval
from ..operators.nested import nested_profile
from ..operators.profile import INDICATORS, profile_long, relative_error
from ..operators.samplers import uniform_size
from ..operators.selection import cutoffs
from ..operators.storage import materialise, small_table
from ..operators.table import AuditTable


def nested_profiles(t: AuditTable, sizes: Callable[[int], Sequence[tuple]], labels: str, seeds: Sequence[int] = (42,),
                    algorithm: str = "md5") -> tuple[DataFrame, int]:
    """Profiles of all samples that are prefixes of one draw order per seed: (seed, labels, indicators, sample_size), and N.

    ``sizes(N)`` lists ``(label values..., size)``; ``labels`` is the DDL of the label columns.  A row is written once per seed
    with the number of the smallest sample that holds it, however many samples do.
    """
    names = [part.split()[0] for part in labels.split(",")]
    seeded = t.df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    draw = Draws(F.col("seed"), algorithm).uniform("row", *t.key_cols)
    listed: list[tuple] = []

    def wanted(totals: dict) -> dict:
        n = max(totals.values(), default=0)
        listed.extend((*item[:-1], min(item[-1], n)) for item in sizes(n))
        return {(s, size): (s, size) for s in seeds for size in {item[-1] for item in listed} if size > 0}

    totals, cuts = cutoffs(seeded, draw, t.key_cols, wanted, group=F.col("seed"))
    n = max(totals.values(), default=0)
    levels = sorted({item[-1] for item in listed if item[-1] > 0})
    spark = t.df.sparkSession
    described = small_table(spark, [(levels.index(item[-1]), *item[:-1]) for item in listed if item[-1] > 0], f"step int, {labels}")
    seed, row_draw = F.col("seed"), F.col("row_draw")
    last = {s: cuts[s, levels[-1]] for s in seeds} if levels else {}
    furthest = F.element_at(F.create_map(*[x for s in seeds for x in (
        F.lit(int(s)), F.lit(-1.0 if s not in last else float("inf") if last[s].everything else last[s].draw))]), seed)
    # one reference to the draw, as a filter repeats the hash expression for every reference
    drawn = seeded.withColumn("row_draw", draw).where(row_draw <= furthest)
    beyond = F.lit(0)
    for s in seeds:
        mine = F.lit(0)
        for size in levels:
            cut = cuts[s, size]
            # equal draws at the end of a sample: the key decides
            mine = mine + (~cut.keeps(row_draw, t.key_cols)).cast("int")
        beyond = F.when(seed == int(s), mine).otherwise(beyond)
    # exploded, so that no filter on the level moves down and repeats the hash for every size
    rows = drawn.withColumn("level", F.explode_outer(F.array(beyond))).where(F.col("level") < len(levels)).select("seed", "level", *t.measured)
    rows = materialise(rows, "curve")  # the samples, not the table, feed the fences and the profile
    found = nested_profile(rows, max(1, len(levels)), t.measured, t.rules, held=len(seeds) * (levels[-1] if levels else 0))
    return found.join(F.broadcast(described), "step").select("seed", *names, *INDICATORS, "sample_size"), n


def progressive_curve(t: AuditTable, budgets: Sequence[float], seeds: Sequence[int] = (42,), truth: DataFrame | None = None,
                      algorithm: str = "md5") -> DataFrame:
    """One profile per (seed, budget) of nested uniform samples, with errors against ``truth`` if given."""
    def sizes(n: int):
        return [(float(b), uniform_size(n, b)) for b in budgets]

    found, n = nested_profiles(t, sizes, "budget double", seeds, algorithm)
    curve = found.withColumn("n_records", F.lit(n).cast("bigint"))
    if truth is None:
        return curve
    return relative_error(curve, truth)


def estimate_chain(curve: DataFrame, by: str = "budget") -> DataFrame:
    """(indicator, step, value) from a curve of one seed: step k is the k-th smallest budget (a handful of rows)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(by), F.col("value"))))
    steps = profile_long(curve.select(by, *INDICATORS)).groupBy("indicator").agg(ordered.alias("steps"))
    return steps.select("indicator", F.posexplode("steps").alias("at", "s")).select(
        "indicator", (F.col("at") + 1).cast("bigint").alias("step"), F.col("s.value").alias("value"))


def curve_intervals(curve: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Wald interval of every indicator at every point of the curve."""
    kept = [c for c in ("seed", "budget", "sample_size") if c in curve.columns]
    return wald_interval(profile_long(curve.select(*kept, *INDICATORS)), confidence=confidence)


def converged(curve: DataFrame) -> DataFrame:
    """Whether the chain of estimates along the budgets has converged (needs at least 20 budgets)."""
    return all_converged(raftery_lewis(estimate_chain(curve)))


def first_settled_budget(curve: DataFrame, width: float) -> DataFrame:
    """Smallest budget per seed whose intervals are all at most ``width`` wide (NULL if none): where to stop."""
    widest = curve_intervals(curve).groupBy("seed", "budget").agg(F.max("width").alias("widest"))
    return widest.groupBy("seed").agg(F.min(F.when(F.col("widest") <= width, F.col("budget"))).alias("budget"))
