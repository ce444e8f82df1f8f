"""Row samplers without a chain: uniform, geometric, size formula, stratified, block and importance-weighted.

Every sampler returns the selected rows as a filter over the audited table, with exact sizes.  Draws hash the row
key, so samples of one seed are nested in the budget and do not depend on partitioning.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Draws
from .profile import profile_table
from .score import EPSILON, CellRules, clipped_weight, score_counts
from .selection import cutoffs, smallest, weight_spread
from .storage import materialise
from .strata import neyman, stratify
from .table import AuditTable, with_ordinal

WEIGHT, DRAW = "w", "__draw"


@dataclass(frozen=True)
class Sample:
    table: AuditTable
    n_total: int
    n_sampled: int
    method: str
    weight: str | None = None
    n_steps: int = 0
    acceptance_rate: float = 1.0
    kept: bool = False

    @property
    def df(self) -> DataFrame:
        return self.table.df

    def stored(self) -> Sample:
        """The sample written once: later passes read the sample, not the whole table again."""
        if self.kept:
            return self
        return replace(self, table=self.table.with_rows(materialise(self.df, self.method), self.n_sampled), kept=True)

    def profile(self, **options) -> DataFrame:
        return profile_table(self.stored().table, self.weight, self.n_total, **options)


def _draws(seed) -> Draws:
    return seed if isinstance(seed, Draws) else Draws(seed)


def _by_draw(t: AuditTable, method: str, size, seed) -> Sample:
    draws, n = _draws(seed), t.rows
    draw, goal = draws.uniform("row", *t.key_cols), size(t.rows)
    share = likely_share(goal, n)
    if 0 < goal and share < 1:
        # the only pass that hashes every row; what it writes holds the sample unless it is too small
        early = materialise(t.df.where(draws.below(share, "row", *t.key_cols)).withColumn(DRAW, draw), method)
        found, cut = smallest(early, F.col(DRAW), t.key_cols, lambda _: goal)
        if found >= goal:
            return Sample(t.with_rows(early.where(cut.keeps(F.col(DRAW), t.key_cols)).drop(DRAW), goal), n, goal, method, kept=True)
    n, cut = smallest(t.df, draw, t.key_cols, size)
    return Sample(t.with_rows(t.df.where(cut.keeps(draw, t.key_cols)), cut.size), n, cut.size, method)


def likely_share(goal: int, n: int) -> float:
    """A draw that the ``goal``-th smallest of ``n`` uniform draws does not reach, save for odds below 1e-9."""
    return (goal + 6 * math.sqrt(goal) + 40) / n if n else 1.0


# sizes as functions of the row count
def uniform_size(n: int, budget: float) -> int:
    return max(1, int(n * budget))


def geometric_size(n: int, budget: float) -> int:
    """Batches n/2, n/4, ... add up to n minus the number of one bits of n."""
    return min(int(n * budget), n - n.bit_count())


def yamane_size(n: int, margin: float = 0.05) -> int:
    return min(n, max(1, int(n / (1 + n * margin**2))))


def geometric_batches(n: int, budget: float) -> list[int]:
    """Cumulative sizes after each batch: the prefixes of one draw order."""
    goal, sizes, batch, taken = int(n * budget), [], n // 2, 0
    while batch >= 1 and taken < goal:
        taken = min(goal, taken + batch)
        sizes.append(taken)
        batch //= 2
    return sizes


def random_uniform(t: AuditTable, budget: float, seed=42) -> Sample:
    return _by_draw(t, "random_uniform", lambda n: uniform_size(n, budget), seed)


def fixed_size(t: AuditTable, n: int, seed=42) -> Sample:
    """Row cap at load: exactly n rows, or the whole table if it is not larger."""
    return _by_draw(t, "fixed_size", lambda rows: min(n, rows), seed)


def geometric(t: AuditTable, budget: float, seed=42) -> Sample:
    return _by_draw(t, "geometric", lambda n: geometric_size(n, budget), seed)


def yamane(t: AuditTable, budget: float = 0.0, seed=42, margin: float = 0.05) -> Sample:
    """n / (1 + n margin^2) rows; the budget plays no part."""
    return _by_draw(t, "yamane", lambda n: yamane_size(n, margin), seed)


def stratified(t: AuditTable, budget: float, seed=42, by: str = "quality", n_strata: int = 3,
               weights: str = "none", min_per_stratum: int = 0) -> Sample:
    """Neyman-allocated uniform draws per stratum; ``weights="design"`` adds N_h / n_h as the row weight."""
    if weights not in ("none", "design"):
        raise ValueError(f"unknown weights {weights!r}")
    stratum, scores, count = stratify(t, by, n_strata)
    n_total = sum(s.rows for s in scores.values())
    n = max(1, int(n_total * budget))
    plan = neyman(scores, n, count, min_per_stratum)
    method = f"stratified_{by}"
    if sum(s.allocated for s in plan) == 0:
        sample = random_uniform(t, budget, seed)
        return Sample(sample.table, sample.n_total, sample.n_sampled, method)
    draw = _draws(seed).uniform("row", *t.key_cols)
    # the only pass that hashes every row; what it writes holds the sample unless a stratum is too small in it
    share = F.lit(0.0)
    for s in plan:
        share = F.when(F.col("stratum") == s.stratum, F.lit(likely_share(s.allocated, s.n_rows) if s.allocated else 0.0)).otherwise(share)
    tagged = t.df.withColumn("stratum", stratum)
    df = materialise(tagged.where(draw < share).withColumn(DRAW, draw), method)

    def chosen(rows: DataFrame, by: Column) -> tuple[dict, dict]:
        return cutoffs(rows, by, t.key_cols, lambda _: {s.stratum: (s.stratum, s.allocated) for s in plan}, group=F.col("stratum"))

    found, cuts = chosen(df, F.col(DRAW))
    stored = all(found.get(s.stratum, 0) >= s.allocated for s in plan)
    if not stored:
        df = tagged.withColumn(DRAW, draw)
        _, cuts = chosen(df, F.col(DRAW))
    kept = F.lit(False)
    for s in plan:
        kept = kept | cuts[s.stratum].keeps(F.col(DRAW), t.key_cols, F.col("stratum"))
    df = df.where(kept).drop(DRAW)
    size = sum(c.size for c in cuts.values())
    weight = None
    if weights == "design":
        weight, w = WEIGHT, F.lit(None).cast("double")
        for s in plan:
            if s.allocated:
                w = F.when(F.col("stratum") == s.stratum, s.n_rows / s.allocated).otherwise(w)
        df = df.withColumn(WEIGHT, w)
    return Sample(t.with_rows(df, size), n_total, size, method, weight, kept=stored)


def cluster(t: AuditTable, budget: float, seed=42, order_cols: Sequence[str] = (), **ordinal_options) -> Sample:
    """Whole blocks of consecutive rows: k = max(10, ceil(sqrt N)) blocks, ceil(b k) of them, thinned to floor(N b).

    Rows follow ``order_cols`` (the key order by default).  Chosen blocks are the smallest draws among the k block
    numbers, so the choice is a filter too.
    """
    draws = _draws(seed)
    df, n = with_ordinal(t, order_cols, **ordinal_options)
    target = max(1, int(n * budget))
    k = max(10, math.ceil(math.sqrt(n)))
    block = max(1, math.ceil(n / k))
    chosen = max(1, min(math.ceil(budget * k), k))
    blocks = df.sparkSession.range(k).withColumnRenamed("id", "block")
    block_draw = draws.uniform("block", "block")
    _, cut = smallest(blocks, block_draw, ["block"], lambda _: chosen)
    df = df.withColumn("block", F.floor(F.col("ordinal") / block).cast("bigint"))
    df = materialise(df.where(cut.keeps(block_draw, ["block"])), "blocks")
    row_draw = draws.uniform("row", *t.key_cols)
    in_blocks, thin = smallest(df, row_draw, t.key_cols, lambda rows: min(target, rows))
    if in_blocks == 0:  # only possible when the last blocks are empty (N <= 81)
        one = _by_draw(t, "cluster", lambda _: 1, seed)
        return Sample(one.table, n, one.n_sampled, "cluster")
    kept = df.where(thin.keeps(row_draw, t.key_cols))
    return Sample(t.with_rows(kept, thin.size), n, thin.size, "cluster", kept=True)


def importance(t: AuditTable, budget: float, seed=42, clip: float | None = 0.95) -> Sample:
    """Draw without replacement with probability ~ score + 1e-6 (smallest exponential / weight), weighted back.

    The weights 1/(N p) differ from 1/(score + 1e-6) by a constant, which normalisation removes.
    """
    rules = CellRules.of(t)
    score = rules.score()
    draw = _draws(seed).exponential("row", *t.key_cols) / (score + EPSILON)
    n, cut = smallest(t.df, draw, t.key_cols, lambda rows: max(1, min(int(rows * budget), rows)), spread=weight_spread)
    df = materialise(t.df.where(cut.keeps(draw, t.key_cols)), "importance")
    weighted = with_inverse_weights(df, rules, clip)
    return Sample(t.with_rows(weighted, cut.size), n, cut.size, "importance", WEIGHT, kept=True)


def with_inverse_weights(sample: DataFrame, rules: CellRules, clip: float | None = 0.95) -> DataFrame:
    """Add ``score`` and the clipped, normalised inverse-score weight ``w`` to a sample."""
    counts = score_counts(sample, rules)[None]
    return sample.withColumn("score", rules.score()).withColumn(WEIGHT, clipped_weight(F.col("score"), counts, clip))

