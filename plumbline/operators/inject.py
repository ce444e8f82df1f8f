"""Error injectors: DataFrame to DataFrame transforms that corrupt a table at a known rate.

Each hit is a hash draw of the row key, so the damage is repeatable, needs no shuffle, and keeps the partitioning.
"With replacement" hits at a mean rate r per cell become hits with probability 1 - exp(-r), the share of cells a
with-replacement draw reaches.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns
from ..functions.draws import Draws
from .selection import smallest
from .storage import materialise

COPY_NO = "copy_no"
COPY_BLOCK = 16  # arrivals of one row are summed up in blocks of so many copies
COPIES_PER_TASK = 500_000


def _draws(seed) -> Draws:
    return seed if isinstance(seed, Draws) else Draws(seed)


def hit_share(mean_hits: float) -> float:
    return -math.expm1(-mean_hits)


def _replace(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(changes)) if changes else df


def inject_missing(df: DataFrame, rate: float, key_cols: Sequence[str], columns: Sequence[str] | None = None,
                   seed=42, mode: str = "hits") -> DataFrame:
    """Null out cells.  ``mode="hits"``: int(n k rate) hits with replacement; ``"bernoulli"``: each cell with ``rate``."""
    if mode not in ("hits", "bernoulli"):
        raise ValueError(f"unknown mode {mode!r}")
    columns = [c for c in df.columns if c not in key_cols] if columns is None else columns
    share = hit_share(rate) if mode == "hits" else rate
    draws = _draws(seed)
    return _replace(df, {c: F.when(~draws.below(share, f"missing:{c}", *key_cols), F.col(f"`{c}`")) for c in columns})


def inject_duplicates(df: DataFrame, rate: float, key_cols: Sequence[str], seed=42,
                      source: DataFrame | None = None, copies: int | None = None) -> DataFrame:
    """Append int(n rate) copies of rows drawn with replacement from ``source`` (default: the table itself).

    Column ``copy_no`` is 0 on the originals and 1, 2, ... on copies; key plus copy_no identifies a row.

    Copies arrive at every row as a unit Poisson process (sums of exponential draws).  The first m arrivals over all
    rows fall on independent, uniformly chosen rows, which is exactly m draws with replacement; finding them needs one
    histogram of arrival times, no row numbers and no join.  The arrivals are written once, as the passes over them are several.
    """
    source = df if source is None else source
    n = source.count()
    m = int(n * rate) if copies is None else copies
    originals = df if COPY_NO in df.columns else df.withColumn(COPY_NO, F.lit(0))
    if n == 0 or m <= 0:
        return originals
    arrived, early = copy_arrivals(source, n, m, key_cols, seed)
    arrived = materialise(arrived, "arrivals")
    names = [*key_cols, COPY_NO]
    _, cut = smallest(arrived, F.col("arrival"), names, lambda _: m, spread=early)
    extra = arrived.where(cut.keeps(F.col("arrival"), names)).drop("arrival")
    return originals.unionByName(extra)


def copy_arrivals(source: DataFrame, n: int, m: int, key_cols: Sequence[str], seed=42) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Copies of the ``n`` rows of ``source`` with their ``arrival``, the first ``m`` among them, and a map of arrivals into [0, 1)."""
    horizon = (m + 12 * math.sqrt(m) + 40) / n  # the m-th arrival is earlier, save for odds below 1e-14
    deepest = _poisson_depth(horizon, n)
    draws = _draws(seed)
    latest = math.exp(-horizon) * (1.0 - 1e-9) - 1e-12  # a safe bound on the draw of a row with a copy, cheaper to look at
    early = source.where(~draws.below(latest, "copy1", *key_cols)).where(draws.exponential("copy1", *key_cols) <= horizon)
    blocks = math.ceil(deepest / COPY_BLOCK)
    if blocks > 1:  # rows with many copies are few but heavy
        tasks = max(source.sparkSession.sparkContext.defaultParallelism, math.ceil(n * deepest / COPIES_PER_TASK))
        early = early.repartition(tasks)
    gaps = F.transform(F.sequence(F.lit(1), F.lit(deepest)), lambda j: draws.exponential(F.concat(F.lit("copy"), j.cast("string")), *key_cols))
    # outer: the optimizer would compute the gaps once more to filter empty arrays, of which there are none
    starts = F.explode_outer(_block_starts(blocks)) if blocks > 1 else F.struct(F.lit(0).alias("no"), F.lit(0.0).alias("start"))
    started = early.withColumn("__gaps", gaps).withColumn("__block", starts)
    inside = F.slice("__gaps", F.col("__block.no") * COPY_BLOCK + 1, F.lit(COPY_BLOCK))
    started = started.where(F.col("__block.start") <= horizon).withColumn("__gaps", inside)
    arrived = started.withColumn("__place", F.explode_outer(F.sequence(F.lit(1), F.size("__gaps"))))
    # summed up in order, gap by gap, from the start of the block
    arrived = arrived.withColumn("arrival", F.aggregate(F.slice("__gaps", F.lit(1), F.col("__place")), F.col("__block.start"), lambda a, g: a + g))
    arrived = arrived.withColumn(COPY_NO, F.col("__block.no") * COPY_BLOCK + F.col("__place")).where(F.col("arrival") <= horizon)
    return arrived.drop("__gaps", "__block", "__place"), lambda a: F.least(a / horizon, F.lit(1.0 - 2.0**-20))


def _block_starts(blocks: int) -> Column:
    """(number, arrival before its first copy) of each block of a row's ``__gaps``."""
    def step(state: Column, no: Column) -> Column:
        ahead = F.aggregate(F.slice("__gaps", no * COPY_BLOCK + 1, F.lit(COPY_BLOCK)), state["at"], lambda a, g: a + g)
        return F.struct(ahead.alias("at"), F.concat(state["starts"], F.array(F.struct(no.alias("no"), state["at"].alias("start")))).alias("starts"))

    none = F.array().cast("array<struct<no: int, start: double>>")
    return F.aggregate(F.sequence(F.lit(0), F.lit(blocks - 1)), F.struct(F.lit(0.0).alias("at"), none.alias("starts")), step, lambda s: s["starts"])


def _poisson_depth(mean: float, n: int) -> int:
    """Copies per row that no row exceeds, save for odds below 1e-12 over the whole table (a Chernoff bound)."""
    log_odds = math.log(1e12 * max(n, 1))
    k = max(1, math.ceil(mean))
    while k * math.log(k / mean) - k + mean < log_odds:
        k += max(1, k // 64)
    return k


def inject_outliers(df: DataFrame, rate: float, key_cols: Sequence[str], columns: Sequence[str] | None = None,
                    seed=42, clean: DataFrame | None = None) -> DataFrame:
    """int(n rate) random cells of the columns move by +-10 (sample sd + 1e-6) of the clean column; missing stays missing."""
    columns = numeric_columns(df, None if columns is None else columns)
    columns = [c for c in columns if c not in key_cols]
    spread = (df if clean is None else clean).agg(*[F.stddev_samp(as_double(c)).alias(f"sd_{i}") for i, c in enumerate(columns)])
    share = hit_share(rate / max(len(columns), 1))
    draws = _draws(seed)
    changes = {}
    for i, c in enumerate(columns):
        hit = draws.below(share, f"outlier:{c}", *key_cols)
        moved = as_double(c) + draws.sign(f"sign:{c}", *key_cols) * 10.0 * (F.coalesce(f"sd_{i}", F.lit(0.0)) + 1e-6)
        changes[c] = F.when(hit, moved).otherwise(as_double(c))
    return _replace(df.crossJoin(F.broadcast(spread)), changes).select(*df.columns)


def replace_with_outliers(df: DataFrame, rate: float, key_cols: Sequence[str], columns: Sequence[str] | None = None,
                          seed=42) -> DataFrame:
    """max(1, int(n rate / 2 / #columns)) cells per numeric column are set to mean +- 10 (population sd + 1e-6).

    Columns with fewer than four values are left alone.
    """
    columns = [c for c in numeric_columns(df, columns) if c not in key_cols]
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), *[a for i, c in enumerate(columns) for a in (
        F.count(as_double(c)).alias(f"n_{i}"), F.avg(as_double(c)).alias(f"mean_{i}"), F.stddev_pop(as_double(c)).alias(f"sd_{i}"))])
    hits = F.greatest(F.lit(1.0), F.floor(F.col("n_rows") * F.lit(rate * 0.5 / max(len(columns), 1))))
    share = 1.0 - F.exp(-hits / F.nullif(F.col("n_rows"), F.lit(0)))
    draws = _draws(seed)
    changes = {}
    for i, c in enumerate(columns):
        hit = (draws.uniform(f"outlier:{c}", *key_cols) < share) & (F.col(f"n_{i}") >= 4)
        level = F.col(f"mean_{i}") + draws.sign(f"sign:{c}", *key_cols) * 10.0 * (F.col(f"sd_{i}") + 1e-6)
        changes[c] = F.when(hit, level).otherwise(as_double(c))
    return _replace(df.crossJoin(F.broadcast(stats)), changes).select(*df.columns)


def inject_levels(df: DataFrame, rate: float, key_cols: Sequence[str], levels: Mapping[str, tuple[float, float, float]],
                  seed=42) -> DataFrame:
    """Malfunction values: int(n rate) hits over the columns of ``levels``, set to mu +- multiple * sigma."""
    share = hit_share(rate / max(len(levels), 1))
    draws = _draws(seed)
    changes = {}
    for c, (mu, sigma, multiple) in levels.items():
        hit = draws.below(share, f"level:{c}", *key_cols)
        changes[c] = F.when(hit, F.lit(mu) + draws.sign(f"sign:{c}", *key_cols) * F.lit(multiple * sigma)).otherwise(as_double(c))
    return _replace(df, changes)


def inject_fd_noise(df: DataFrame, rate: float, key_cols: Sequence[str], dependent: str, seed=42,
                    low: float = -100.0, high: float = 100.0) -> DataFrame:
    """Break a dependency: int(n rate) hits overwrite a numeric dependent with a uniform value."""
    draws = _draws(seed)
    hit = draws.below(hit_share(rate), f"break:{dependent}", *key_cols)
    noise = F.lit(low) + F.lit(high - low) * draws.uniform(f"noise:{dependent}", *key_cols)
    return df.withColumn(dependent, F.when(hit, noise).otherwise(as_double(dependent)))


def inject_fd_per_key(df: DataFrame, rate: float, key_cols: Sequence[str], determinant: str, dependent: str,
                      labels: Sequence[str], seed=42) -> DataFrame:
    """Break a dependency per determinant: max(1, int(#keys rate)) keys get a wrong label in one random row each.

    The chosen keys are a filter on the determinant's own draw; the row is the smallest draw per chosen key, an
    aggregation, so no determinant is gathered; the picks meet the table on the unique row key.
    """
    draws = _draws(seed)
    keys = df.where(F.col(determinant).isNotNull()).select(determinant).distinct()
    key_draw = draws.uniform(f"key:{determinant}", determinant)
    _, cut = smallest(keys, key_draw, [determinant], lambda n: max(1, int(n * rate)))
    hit = F.coalesce(F.col(determinant).isNotNull() & cut.keeps(key_draw, [determinant]), F.lit(False))
    chosen = df.where(hit)
    identity = F.struct(*[F.col(k) for k in key_cols])
    picks = chosen.groupBy(determinant).agg(
        F.min(F.struct(draws.uniform("pick", *key_cols).alias("u"), identity.alias("key"))).alias("first")
    ).select(*[F.col(f"first.key.{k}").alias(k) for k in key_cols], F.lit(True).alias("picked"))
    others = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: ~x.eqNullSafe(F.col(dependent)))
    wrong = F.get(others, F.floor(draws.uniform("label", *key_cols) * F.size(others)).cast("int"))
    # only rows of chosen keys are shuffled; the rest of the table passes through
    touched = chosen.join(picks, list(key_cols), "left")
    touched = touched.withColumn(dependent, F.when(F.col("picked"), wrong).otherwise(F.col(dependent)))
    return df.where(~hit).unionByName(touched.select(*df.columns))
