"""Chunks of many batch sizes from one count: leaves of one small size, merged where a chain wants larger batches.

A row's leaf is a hash draw inside its stream.  A chunk of a batch size is a run of consecutive leaves, so the sums of its
rows are sums of leaf sums, and the table is hashed, placed and counted once whatever the number of batch sizes.  Leaves hold
about as many rows as the greatest common divisor of the batch sizes (and of their quarters in the forced stream), so
doubling sizes give a binary tree.  The warm start of a chain (as many rows as its batch) lies in leaves too and is subtracted.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import Draws
from .chains import FORCED, SEGMENT, ChainState, Proposals, Walk, chain_goal, narrow_rows, steps_to_goal, take_chunks
from .score import CellRules
from .selection import Cutoff, cutoffs, weight_spread
from .storage import materialise
from .table import AuditTable


@dataclass(frozen=True)
class ChunkTree:
    rows: DataFrame  # narrow rows with stream and leaf, in storage
    leaves: DataFrame  # stream, leaf, size, defects, in storage
    n_leaves: dict[str, int]
    starts: dict[int, Cutoff]  # warm start per batch size
    warm: DataFrame  # rows of the largest warm start, which holds the others
    n: int
    unit: int
    forced_unit: int

    def merged(self, batch: int) -> dict[bool, int]:
        """Leaves per chunk, for the forced stream and for the others."""
        return {True: max(1, batch // 4) // self.forced_unit, False: batch // self.unit}

    def chunk(self, batch: int) -> Column:
        per = self.merged(batch)
        return F.floor(F.col("leaf") / F.when(F.col("stream") == FORCED, F.lit(per[True])).otherwise(F.lit(per[False]))).cast("bigint")

    def n_chunks(self, batch: int) -> dict[str, int]:
        per = self.merged(batch)
        return {s: -(-n // per[s == FORCED]) for s, n in self.n_leaves.items()}


def plant(t: AuditTable, batches: Sequence[int], seed: int, proposals: Proposals, rules: CellRules) -> ChunkTree:
    """Place all rows once and count their leaves; ``batches`` are the batch sizes the tree will serve."""
    if not batches or min(batches) < 1:
        raise ValueError("batch sizes must be at least 1")
    draws, keys = Draws(seed), list(t.key_cols)
    unit, forced_unit = math.gcd(*batches), math.gcd(*[max(1, b // 4) for b in batches])
    streamed = materialise(narrow_rows(t, proposals, rules, draws), "streamed")
    sizes = {r["stream"]: r["count"] for r in streamed.groupBy("stream").count().collect()}  # a row per stream
    n_leaves = {s: max(1, c // (forced_unit if s == FORCED else unit)) for s, c in sizes.items()}
    per_stream = F.element_at(F.create_map(*[x for s, c in sorted(n_leaves.items()) for x in (F.lit(s), F.lit(c))]), F.col("stream")) if n_leaves else F.lit(1)
    rows = streamed.withColumn("leaf", F.floor(F.col("u_chunk") * per_stream).cast("bigint")).drop("u_chunk")
    leaves = materialise(rows.groupBy("stream", "leaf").agg(F.count(F.lit(1)).alias("size"), F.sum("defects").alias("defects")), "leaves")
    n = sum(sizes.values())
    _, starts = cutoffs(rows, F.col("start"), keys, lambda _: {b: (None, min(b, n)) for b in batches}, spread=weight_spread)
    warm = materialise(rows.where(starts[max(batches)].keeps(F.col("start"), keys)), "warm")
    return ChunkTree(rows, leaves, n_leaves, starts, warm, n, unit, forced_unit)


def walk_tree(tree: ChunkTree, batch: int, budget: float, seed: int, keys: list[str], proposals: Proposals, rules: CellRules,
              lam: float | None, segment: int = SEGMENT) -> Walk:
    """The chain of one batch size over the tree.  Where the pool has to be hashed again it goes on like any other chain."""
    draws, cells, forced_size = Draws(seed), max(len(rules.columns), 1), max(1, batch // 4)
    in_start = tree.starts[batch].keeps(F.col("start"), keys)
    warm, pool = tree.warm.where(in_start), tree.rows.where(~in_start)
    first = warm.agg(F.coalesce(F.sum("defects"), F.lit(0)).alias("d"), F.count(F.lit(1)).alias("n")).first()
    goal = chain_goal(tree.n, budget, batch)

    def first_round(state: ChainState):
        sums = tree.leaves.select("stream", tree.chunk(batch).alias("chunk"), "size", "defects")
        minus = warm.select("stream", tree.chunk(batch).alias("chunk"), F.lit(-1).cast("bigint").alias("size"), (-F.col("defects")).alias("defects"))
        sums = sums.unionByName(minus).groupBy("stream", "chunk").agg(F.sum("size").alias("size"), F.sum("defects").alias("defects"))
        placed = pool.withColumn("chunk", tree.chunk(batch))
        return take_chunks(placed, sums, tree.n_chunks(batch), proposals, draws, lam, forced_size, goal, cells, state, 0, segment)

    return steps_to_goal(pool, warm, tree.n, goal, ChainState(first["d"], first["n"]), keys, proposals, draws, lam, batch, cells, segment, first_round)
