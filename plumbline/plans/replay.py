"""Many budgets from one chain: the log of its decisions is cut where each budget is reached.

What a chain decides does not depend on where it will stop, so the chain of a small budget is the beginning of the chain
of a large one.  One chain per seed runs to the largest budget; the rows it took carry ``entry``, how many rows the
chain held before the step that took them.  A budget with goal g holds the rows with ``entry < g``, cut to g by their row draw
as in a single run.  Only one thing in a chain depends on its goal: a round lists no more steps than the goal can need.  Where a
budget would have come to the end of its list, and so would have hashed the pool again, its chain runs by itself.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Draws
from ..operators.chains import CARRIED, Proposals, Walk, chain_goal, decile_proposals, guided_proposals, walk_chain
from ..operators.chunk_tree import plant, walk_tree
from ..operators.profile import known, profile_held
from ..operators.score import CellRules, clip_label, clipped_weight, score_counts
from ..operators.selection import cutoffs
from ..operators.storage import materialise, small_table
from ..operators.table import AuditTable, identified

CONDITION = "condition int, method string, budget double, seed int, n_sampled bigint"
LABEL = "__condition"
#: proposals of a chain by name, and whether they are accepted by score
CHAIN_PROPOSALS: dict[str, tuple[Callable[..., Proposals], bool]] = {
    "metropolis_hastings": (lambda t, rules, draws, edges: Proposals(), True),
    "gibbs": (lambda t, rules, draws, edges: decile_proposals(t, draws), False),
    "dag": (guided_proposals, True),
    "dag_uniform": (guided_proposals, True),
}


@dataclass(frozen=True)
class Replay:
    """Rows of all samples, once per (budget, seed) that holds them, in storage."""

    table: AuditTable
    method: str
    rows: DataFrame  # the columns of the table and LABEL
    conditions: tuple[tuple, ...]  # number, method, budget, seed, rows, and more as ``schema`` says
    n_total: int
    n_chains: int
    schema: str = CONDITION

    def profile(self, clips: Sequence[float | None] = (0.95,)) -> DataFrame:
        """Rates per budget, seed and clip level of the inverse-score weights; ``dag_uniform`` has no weights to clip."""
        t, rules, label, weights = self.table, CellRules.of(self.table), F.col(LABEL), {}
        if self.method == "dag_uniform":
            clips, weights = (None,), {(c[0], "none"): None for c in self.conditions}
        else:
            for k, counts in sorted(score_counts(self.rows, rules, label).items()):
                weights |= {(k, clip_label(clip)): clipped_weight(rules.score(), counts, clip) for clip in clips}
        emitted = sum(c[4] for c in self.conditions) * len(clips)
        held = {k: label == k for k, _ in weights}
        p = profile_held(self.rows, t.measured, t.rules, held, weights, LABEL, "clip_percentile", emitted).drop("sample_size")
        listed = small_table(self.rows.sparkSession, self.conditions, self.schema)
        joined = p.join(F.broadcast(listed), p[LABEL] == listed["condition"]).drop(LABEL, "condition")
        return joined.withColumn("n_records", F.lit(self.n_total).cast("bigint"))


def replay(t: AuditTable, budgets: Sequence[float], seeds: Sequence[int], method: str = "dag", edges: DataFrame | None = None,
           lam: float = 2.0, batch_size: int = 200, **options) -> Replay:
    """The samples that ``method`` gives for every budget and seed, from one chain per seed."""
    if method not in CHAIN_PROPOSALS:
        raise ValueError(f"not a chain: {method!r}; known: {sorted(CHAIN_PROPOSALS)}")
    if not budgets or not seeds:
        raise ValueError("no budget or no seed")
    propose, by_score = CHAIN_PROPOSALS[method]
    rules, keys = CellRules.of(t), list(t.key_cols)
    budgets = sorted(dict.fromkeys(float(b) for b in budgets))
    parts, conditions, n, chains = [], [], 0, 0
    carry = identified(t)
    for seed in dict.fromkeys(int(s) for s in seeds):
        proposals = propose(t, rules, Draws(seed), edges)

        def run(budget: float) -> Walk:
            return walk_chain(t, budget, seed, proposals, rules, lam if by_score else None, batch_size, carry=carry, **options)

        walk, open_budgets, alone = run(budgets[-1]), list(budgets), {}
        chains, n = chains + 1, walk.n
        for b in _listed_too_few(walk, budgets[:-1], batch_size):
            alone[b] = run(b)
            chains += 1
        for w, held in [(walk, [b for b in open_budgets if b not in alone]), *[(w, [b]) for b, w in alone.items()]]:
            picked, sizes = _cut(w, held, keys, batch_size, len(conditions))
            parts.append(picked)
            conditions += [(len(conditions) + i, method, b, seed, size) for i, (b, size) in enumerate(zip(held, sizes))]
    return Replay(t, method, _fetched(t, parts), tuple(conditions), n, chains)


def batch_sweep(t: AuditTable, batches: Sequence[int], budget: float, seeds: Sequence[int], method: str = "dag", edges: DataFrame | None = None,
                lam: float = 2.0, **options) -> Replay:
    """Samples of one budget by batch size, from one chunk tree per seed; ``batch_size`` is a column of the profile.

    The tree cuts streams a little otherwise than a chain of one batch size does, so samples equal those of ``draw_sample``
    in distribution only.
    """
    if method not in CHAIN_PROPOSALS:
        raise ValueError(f"not a chain: {method!r}; known: {sorted(CHAIN_PROPOSALS)}")
    if not batches or not seeds:
        raise ValueError("no batch size or no seed")
    propose, by_score = CHAIN_PROPOSALS[method]
    rules, keys, batches = CellRules.of(t), list(t.key_cols), sorted(dict.fromkeys(int(b) for b in batches))
    parts, conditions, n = [], [], 0
    for seed in dict.fromkeys(int(s) for s in seeds):
        proposals = propose(t, rules, Draws(seed), edges)
        tree = plant(t, batches, seed, proposals, rules)
        n = tree.n
        for b in batches:
            walk = walk_tree(tree, b, budget, seed, keys, proposals, rules, lam if by_score else None, **options)
            picked, sizes = _cut(walk, [budget], keys, b, len(conditions))
            parts.append(picked)
            conditions.append((len(conditions), method, float(budget), seed, sizes[0], b))
    return Replay(t, method, _fetched(t, parts), tuple(conditions), n, len(conditions), CONDITION + ", batch_size int")


def _fetched(t: AuditTable, parts: Sequence[DataFrame]) -> DataFrame:
    """The sampled rows.  They bring their columns along or fetch them by key; if keys repeat, all rows of a key come for each that is picked."""
    picked = parts[0]
    for part in parts[1:]:
        picked = picked.unionByName(part)
    others = [c for c in t.df.columns if c not in t.key_cols]
    if CARRIED in picked.columns:  # a row without its whole key is found by no key
        return picked.where(known(t.key_cols)).select(*t.key_cols, *[F.col(f"{CARRIED}.`{c}`").alias(c) for c in others], LABEL)
    return materialise(t.df.join(picked, list(t.key_cols)), "replay")


def _listed_too_few(walk: Walk, budgets: Sequence[float], batch_size: int) -> list[float]:
    """Budgets whose own chain would have listed fewer steps in some round than the long chain took until their goal."""
    forced = max(1, batch_size // 4)
    goals, found = {b: chain_goal(walk.n, b, batch_size) for b in budgets}, set()
    for begin, most, decisions in walk.rounds:
        reached = {b: g for b, g in goals.items() if g > begin}
        if reached:
            names = list(reached)
            row = decisions.agg(*[F.count_if(F.col("entry") < F.lit(reached[b])).alias(f"n_{i}") for i, b in enumerate(names)]).first()
            found |= {b for i, b in enumerate(names) if row[f"n_{i}"] > min(most, -(-(reached[b] - begin) // forced))}
    return [b for b in budgets if b in found]


def _cut(walk: Walk, budgets: Sequence[float], keys: Sequence[str], batch_size: int, first: int) -> tuple[DataFrame, list[int]]:
    """(keys, LABEL) of the samples of the budgets, labels counting from ``first``, and their sizes."""
    goals = [chain_goal(walk.n, b, batch_size) for b in budgets]
    entry, draw, label = F.col("entry"), F.col("row_draw"), F.col(LABEL)
    held = F.filter(F.array(*[F.when(entry < F.lit(g), F.lit(first + i)) for i, g in enumerate(goals)]), lambda k: k.isNotNull())
    row = [c for c in walk.rows.columns if c == CARRIED]
    rows = materialise(walk.rows.select(*keys, "row_draw", *row, F.explode(held).alias(LABEL)), "log")
    _, cuts = cutoffs(rows, draw, keys, lambda totals: {k: (k, min(goals[k - first], totals[k])) for k in sorted(totals)}, group=label)
    kept = F.lit(False)
    for cut in cuts.values():
        kept = kept | cut.keeps(draw, keys, label)
    return rows.where(kept).select(*keys, *row, LABEL), [cuts[first + i].size if first + i in cuts else 0 for i in range(len(goals))]
