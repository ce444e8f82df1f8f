"""Many samples of one table at once: every row carries a bitmap of the conditions (method, budget, seed) that hold it.

A condition run alone scans the table for its cutoff, writes its sample, and profiles it.  For methods without a chain
membership is a predicate on the row, so here scores, strata, chosen blocks and draws of the rows that a sample may hold are written
once, all cutoffs are found on that narrow table, one scan sets the bits, and one profile that shuffles a row once estimates every condition.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import HALF_STEP, Draws
from ..operators.profile import any_of, profile_held
from ..operators.samplers import likely_share
from ..operators.score import EPSILON, CellRules, ScoreCounts, clipped_weight, score_counts
from ..operators.selection import cutoffs, smallest, weight_spread
from ..operators.storage import materialise, small_table
from ..operators.strata import neyman, stratify
from ..operators.table import AuditTable, ordinals_of_blocks
from .registry import PREFIX_SIZES

STRATIFIED = {"stratified_column": "column", "stratified_quality": "quality"}
CHAIN_FREE = (*PREFIX_SIZES, "cluster", "importance", *STRATIFIED)
WORD = 62  # conditions in one word of the bitmap
FEW = 1000  # a table of fewer rows is written whole
CONDITION = "condition int, method string, budget double, seed bigint, n_sampled bigint"


@dataclass(frozen=True)
class Membership:
    """``rows``: key, measured columns, score and bitmap words; ``conditions``: (number, method, budget, seed, size)."""

    table: AuditTable
    rows: DataFrame
    conditions: tuple[tuple[int, str, float, int, int], ...]
    n_total: int

    def exploded(self) -> DataFrame:
        """One row per row and condition that holds it."""
        bits = [F.when(F.col(f"word_{k // WORD}").bitwiseAND(F.lit(1 << (k % WORD))) != 0, F.lit(k)) for k, *_ in self.conditions]
        held = F.filter(F.array(*bits), lambda k: k.isNotNull())
        return self.rows.select(*self.table.measured, "score", F.explode(held).alias("condition"))

    def held(self) -> dict[int, Column]:
        """Whether a row is in the sample of a condition."""
        return {k: F.col(f"word_{k // WORD}").bitwiseAND(F.lit(1 << (k % WORD))) != 0 for k, *_ in self.conditions}

    def profile(self) -> DataFrame:
        """Weighted rates per condition: method, budget, seed, n_sampled and the indicators."""
        held = self.held()
        words = list(dict.fromkeys(f"word_{k // WORD}" for k in held))
        # nearly all rows are held by a condition; every pass would evaluate the predicates of all conditions for every bit
        rows = materialise(self.rows.select(*self.table.measured, "score", *words), "tagged")
        weights: dict[tuple[int, str], Column | None] = {(k, ""): None for k in held}
        weighted = [k for k, method, *_ in self.conditions if method == "importance"]
        if weighted:  # clipped at the sample's own quantile; the score has few values
            found = rows.groupBy("score").agg(*[F.count_if(held[k]).alias(f"n_{k}") for k in weighted]).collect()
            for k in weighted:
                counts = ScoreCounts(tuple(sorted((r["score"], r[f"n_{k}"]) for r in found if r[f"n_{k}"])))
                weights[k, ""] = clipped_weight(F.col("score"), counts)
        emitted = sum(size for *_, size in self.conditions)
        p = profile_held(rows, self.table.measured, self.table.rules, held, weights, "condition", "tag", emitted).drop("tag")
        listed = small_table(rows.sparkSession, self.conditions, CONDITION)
        return p.join(F.broadcast(listed), "condition").drop("condition").withColumn("n_records", F.lit(self.n_total).cast("bigint"))


def membership(t: AuditTable, methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int],
               order_cols: Sequence[str] = (), **ordinal_options) -> Membership:
    """Tags the rows of the table; the samples are those that ``draw_sample`` gives for each condition alone.

    ``order_cols`` are the order of ``cluster``'s blocks (the key order by default).  Conditions whose sample is empty have no row in a profile.
    """
    unknown = sorted(set(methods) - set(CHAIN_FREE))
    if unknown:
        raise ValueError(f"not a method without a chain: {unknown}; known: {sorted(CHAIN_FREE)}")
    keys, rules, n = list(t.key_cols), CellRules.of(t), t.rows
    strata = {m: stratify(t, STRATIFIED[m]) for m in methods if m in STRATIFIED}
    plans = {(m, b): neyman(scores, max(1, int(n * b)), count) for m, (_, scores, count) in strata.items() for b in budgets}
    score = rules.score()
    columns = {"score": score, **{f"__{m}": stratum for m, (stratum, _, _) in strata.items()}}
    for s in seeds:
        columns[f"__row_{s}"] = Draws(s).uniform("row", *keys)
    blocks: dict[tuple, tuple[Column, str]] = {}  # (budget, seed) -> predicate of a block number, column of the rows in the chosen blocks
    source = t.df
    if "cluster" in methods:
        size = max(1, math.ceil(n / _block_count(n)))
        for i, (b, s) in enumerate((b, s) for b in budgets for s in seeds):
            blocks[b, s] = _chosen_blocks(t.df.sparkSession, n, b, s), f"__cluster_{i}"
        source = ordinals_of_blocks(t, order_cols, size, _block_count(n), [inside for inside, _ in blocks.values()], "__ordinal", **ordinal_options)
        number = F.floor(F.col("__ordinal") / size).cast("bigint")  # null in rows that are in no chosen block
        source = source.withColumn("__block", number)
        columns |= {name: F.col("__block").isNotNull() & inside for inside, name in blocks.values()}
    kept = list(dict.fromkeys([*keys, *t.measured]))
    # the filter below looks at a number that cannot be moved, so it stays above the draws and repeats no hash
    drawn = source.select(*[F.col(f"`{c}`") for c in kept], *["__block"] * bool(blocks), *[c.alias(name) for name, c in columns.items()],
                          F.monotonically_increasing_id().alias("__fixed"))
    early = _early(methods, budgets, seeds, n, strata, plans, score_counts(t.df, rules)[None] if "importance" in methods else None)
    base = None
    if early:  # written are the rows that a sample may hold, unless one of them turns out to need more
        likely = any_of([*[row for row, *_ in early], *[F.col(name) for _, name in blocks.values()]])
        base = materialise(drawn.where(likely & (F.col("__fixed") >= 0)).drop("__fixed"), "membership")
        row = base.agg(*[F.count_if(is_early).alias(f"n_{i}") for i, (is_early, _) in enumerate(early)]).first()
        if any(row[f"n_{i}"] < needed for i, (_, needed) in enumerate(early)):
            base = None
    if base is None:
        base = materialise(drawn.drop("__fixed"), "membership")

    found: dict[tuple, tuple[Column, int]] = {}  # (method, budget, seed) -> predicate and size
    for s in seeds:
        draw = F.col(f"__row_{s}")
        prefix = [m for m in methods if m in PREFIX_SIZES]
        if prefix:
            _, cuts = cutoffs(base, draw, keys, lambda _: {(m, b): (None, min(n, PREFIX_SIZES[m](n, b))) for m in prefix for b in budgets})
            found |= {(m, b, s): (cut.keeps(draw, keys), cut.size) for (m, b), cut in cuts.items()}
        for m in strata:
            stratum = F.col(f"__{m}")
            _, cuts = cutoffs(base, draw, keys, lambda _: {(b, h.stratum): (h.stratum, h.allocated) for b in budgets for h in plans[m, b]}, group=stratum)
            for b in budgets:
                plan = plans[m, b]
                parts = [cuts[b, h.stratum] for h in plan]
                if sum(c.size for c in parts) == 0:  # nothing was allocated: uniform rows, as alone
                    _, one = smallest(base, draw, keys, lambda _: max(1, int(n * b)))
                    parts, predicate = [one], one.keeps(draw, keys)
                else:
                    predicate = F.lit(False)
                    for c in parts:
                        predicate = predicate | c.keeps(draw, keys, stratum)
                found[m, b, s] = predicate, sum(c.size for c in parts)
        if "importance" in methods:
            raced = _raced(s)
            _, cuts = cutoffs(base, raced, keys, lambda _: {b: (None, max(1, min(int(n * b), n))) for b in budgets}, spread=weight_spread)
            found |= {("importance", b, s): (cut.keeps(raced, keys), cut.size) for b, cut in cuts.items()}
        if "cluster" in methods:
            for b in budgets:
                found["cluster", b, s] = _blocks(base, n, b, F.col(blocks[b, s][1]), draw, keys)

    conditions = tuple((k, m, float(b), int(s), found[m, b, s][1]) for k, (m, b, s) in enumerate((m, b, s) for m in methods for b in budgets for s in seeds))
    words: dict[str, Column] = {}
    for k, m, b, s, _ in conditions:
        bit = F.when(found[m, b, s][0], F.lit(1 << (k % WORD))).otherwise(F.lit(0)).cast("bigint")
        name = f"word_{k // WORD}"
        words[name] = words[name].bitwiseOR(bit) if name in words else bit
    tagged = base.select(*dict.fromkeys([*keys, *t.measured]), "score", *[w.alias(name) for name, w in words.items()])
    return Membership(t, tagged, conditions, n)


def _raced(seed: int) -> Column:
    """The draw of ``importance`` from the stored row draw."""
    return -F.ln(F.col(f"__row_{seed}") + F.lit(HALF_STEP)) / (F.col("score") + EPSILON)


def _early(methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], n: int, strata: dict, plans: dict,
           scores: ScoreCounts | None) -> list[tuple[Column, int]]:
    """(rows whose draw is early, rows that a sample needs of them) for every draw order; empty if the table is small.

    Blocks are not listed: they are known beforehand.
    """
    if n < FEW:
        return []
    out = []
    for s in seeds:
        draw = F.col(f"__row_{s}")
        goals = [min(n, PREFIX_SIZES[m](n, b)) for m in methods if m in PREFIX_SIZES for b in budgets]
        goals += [max(1, int(n * b)) for (_, b), plan in plans.items() if sum(h.allocated for h in plan) == 0]
        if goals:
            out.append((draw < likely_share(max(goals), n), max(goals)))
        for m, (_, _, count) in strata.items():
            for h in range(count):
                most, size = max(plans[m, b][h].allocated for b in budgets), plans[m, budgets[0]][h].n_rows
                if most:
                    out.append(((F.col(f"__{m}") == h) & (draw < likely_share(most, size)), most))
        if scores is not None:
            goal = max(max(1, min(int(n * b), n)) for b in budgets)
            out.append((_raced(s) < likely_race(scores, goal), goal))
    return out


def likely_race(scores: ScoreCounts, goal: int) -> float:
    """A draw of ``importance`` that the ``goal``-th smallest does not reach, save for odds below 1e-9."""
    wanted, low, high = goal + 6 * math.sqrt(goal) + 40, -64.0, 64.0
    if wanted >= scores.rows:
        return math.inf
    for _ in range(60):  # of its logarithm: the rows expected below it grow with it
        middle = (low + high) / 2
        expected = scores.total(lambda score: -math.expm1(-math.exp(middle) * (score + EPSILON)))
        low, high = (middle, high) if expected < wanted else (low, middle)
    return math.exp(high)


def _block_count(n: int) -> int:
    return max(10, math.ceil(math.sqrt(n)))


def _chosen_blocks(spark, n: int, budget: float, seed: int) -> Column:
    """Whether the block with the number ``__block`` is chosen."""
    count = _block_count(n)
    chosen = max(1, min(math.ceil(budget * count), count))
    numbers = spark.range(count).withColumnRenamed("id", "__block")
    draw = Draws(seed).uniform("block", "__block")
    _, cut = smallest(numbers, draw, ["__block"], lambda _: chosen)
    return cut.keeps(draw, ["__block"])


def _blocks(base: DataFrame, n: int, budget: float, inside: Column, draw: Column, keys: Sequence[str]) -> tuple[Column, int]:
    """Rows in the chosen blocks of consecutive rows, thinned to the budget."""
    target = max(1, int(n * budget))
    held, thin = smallest(base.where(inside), draw, keys, lambda r: min(target, r))
    if held == 0:  # only possible when the last blocks are empty
        _, one = smallest(base, draw, keys, lambda _: 1)
        return one.keeps(draw, keys), one.size
    return inside & thin.keeps(draw, keys), thin.size
