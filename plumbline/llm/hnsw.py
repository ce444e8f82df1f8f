"""Nearest neighbours by inner product: one hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by a hash of their content, after equal vectors have been folded into one (each keeps the
smallest ids, as many as a result can need). A shard's graph is a set of flat arrays: vectors, levels and, per level, a
table of neighbour numbers. Inner products become distances by one more coordinate (the missing part of the largest
norm), so long vectors are found as well. Insertion and search run for many vectors side by side in numpy.

The graph only proposes candidates. Their scores are computed in double precision on the original vectors, so a returned
score and order are exact; what the graph can miss is measured by recall against brute force in the tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import keep

LINKS, WIDTH_BUILD, WIDTH_SEARCH = 16, 48, 96
#: Vectors of a shard; the number of shards follows from the table.
SHARD_ROWS = 6000
#: Queries that search side by side.
AT_ONCE = 256


class Graph:
    """Flat arrays of a small-world graph over unit-like vectors; distances are squared Euclidean."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, width: int = WIDTH_BUILD, seed: int = 5):
        norms = np.einsum("nd,nd->n", vectors, vectors)
        lift = np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))
        self.x = np.hstack([vectors, lift[:, None]]).astype(np.float32)
        self.square = np.einsum("nd,nd->n", self.x, self.x)
        self.links, self.width, n = links, width, len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(rng.random(n)) / np.log(links)).astype(int), 6)
        if n:
            self.level[0] = self.level.max()
        self.tables = [np.full((n, 2 * links if k == 0 else links), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.done = min(1, n)
        size = 1
        while self.done < n:  # batches grow with the graph, so most neighbours of a new vector are in it already
            self._insert(np.arange(self.done, min(n, self.done + size)))
            size = min(AT_ONCE, max(1, self.done // 4))

    def _distances(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """[query, k] distances (without the query's own square) to rows [query, k]; -1 is infinitely far."""
        d = self.square[rows] - 2 * np.einsum("qkd,qd->qk", self.x[rows], queries)
        return np.where(rows >= 0, d, np.inf)

    def _search(self, queries: np.ndarray, entry: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `width` vectors of a level for every query, nearest first, walking from [query, k] entries."""
        count, table = len(queries), self.tables[level]
        seen = np.zeros((count, len(self.x) + 1), bool)  # the last column takes the -1
        own = np.arange(count)
        rows = np.full((count, width), -1, np.int64)
        far = np.full((count, width), np.inf, np.float32)
        rows[:, : entry.shape[1]] = entry
        far[:, : entry.shape[1]] = self._distances(queries, entry)
        order = np.argsort(far, axis=1, kind="stable")
        rows, far = np.take_along_axis(rows, order, 1), np.take_along_axis(far, order, 1)
        open_ = rows >= 0
        seen[own[:, None], rows] = True
        active = own
        while len(active):
            best = np.where(open_[active], far[active], np.inf)
            pick = best.argmin(axis=1)
            going = np.isfinite(best[np.arange(len(active)), pick])
            active, pick = active[going], pick[going]
            if not len(active):
                break
            open_[active, pick] = False
            near = table[rows[active, pick]].astype(np.int64)
            near[seen[active[:, None], near]] = -1
            seen[active[:, None], near] = True
            all_rows = np.hstack([rows[active], near])
            all_far = np.hstack([far[active], self._distances(queries[active], near).astype(np.float32)])
            all_open = np.hstack([open_[active], near >= 0])
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            rows[active], far[active] = np.take_along_axis(all_rows, order, 1), np.take_along_axis(all_far, order, 1)
            open_[active] = np.take_along_axis(all_open, order, 1) & np.isfinite(far[active])
        return rows, far

    def _choose(self, owner: np.ndarray, rows: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Neighbours of each owner: a candidate is taken unless one taken before is nearer to it than the owner is; then filled up."""
        count, width = rows.shape
        safe = np.maximum(rows, 0)
        between = self.square[safe][:, :, None] + self.square[safe][:, None, :] - 2 * np.einsum("nid,njd->nij", self.x[safe], self.x[safe])
        own = far + self.square[owner][:, None]
        taken, left = np.zeros((count, width), bool), rows >= 0
        for k in range(width):
            shadowed = (taken & (between[:, k] < own[:, k][:, None])).any(axis=1)
            taken[:, k] = left[:, k] & ~shadowed & (taken.sum(axis=1) < most)
        rank = np.where(taken, 0, np.where(left, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(rows, order, 1)

    def _insert(self, new: np.ndarray) -> None:
        top, before = len(self.tables) - 1, self.done
        entry = np.zeros((len(new), 1), np.int64)
        self.done = int(new[-1]) + 1
        for level in range(top, -1, -1):
            here = self.level[new] >= level
            rows, far = self._search(self.x[new], entry, level, self.width if here.any() else 1)
            if here.any():
                who = new[here]
                peers = np.broadcast_to(who, (len(who), len(who))).copy()  # those inserted side by side may be neighbours, too
                peers[peers == who[:, None]] = -1
                peer_far = self._distances(self.x[who], peers)
                all_rows, all_far = np.hstack([rows[here], peers]), np.hstack([far[here], peer_far])
                order = np.argsort(all_far, axis=1, kind="stable")[:, : self.width]
                chosen = self._choose(who, np.take_along_axis(all_rows, order, 1), np.take_along_axis(all_far, order, 1), self.links)
                self.tables[level][who, : chosen.shape[1]] = chosen
                self._link_back(level, who, chosen)
            entry = rows[:, : min(rows.shape[1], 8)]
        assert before < self.done

    def _link_back(self, level: int, who: np.ndarray, chosen: np.ndarray) -> None:
        """Adds the reverse links; a full neighbour chooses anew among its old and new links."""
        table = self.tables[level]
        source, target = np.repeat(who, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owners, begin, counts = np.unique(target, return_index=True, return_counts=True)
        most, widest = table.shape[1], int(counts.max(initial=0))
        extra = np.full((len(owners), widest), -1, np.int64)
        extra[np.repeat(np.arange(len(owners)), counts), np.arange(len(target)) - np.repeat(begin, counts)] = source
        for at in range(0, len(owners), AT_ONCE):
            own = owners[at : at + AT_ONCE]
            rows = np.hstack([table[own], extra[at : at + AT_ONCE]])
            rows.sort(axis=1)
            rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
            far = self._distances(self.x[own], rows)
            order = np.argsort(far, axis=1, kind="stable")[:, : most + 16]
            rows, far = np.take_along_axis(rows, order, 1), np.take_along_axis(far, order, 1)
            fits = (rows >= 0).sum(axis=1) <= most
            kept = np.full((len(own), most), -1, np.int64)
            plain = rows[:, :most]
            kept[:, : plain.shape[1]] = plain
            if (~fits).any():
                picked = self._choose(own[~fits], rows[~fits], far[~fits], most)
                kept[~fits, : picked.shape[1]] = picked
            table[own] = kept

    def nearest(self, queries: np.ndarray, width: int = WIDTH_SEARCH) -> np.ndarray:
        """Rows of about the `width` largest inner products for every query; -1 where there are fewer."""
        q = np.hstack([queries, np.zeros((len(queries), 1))]).astype(np.float32)
        entry = np.zeros((len(q), 1), np.int64)
        for level in range(len(self.tables) - 1, 0, -1):
            entry = self._search(q, entry, level, 4)[0]
            entry = np.where(entry >= 0, entry, entry[:, :1])[:, :1]
        return self._search(q, entry, 0, width)[0]


def _sound(vector: str) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20,
           width: int = WIDTH_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each query among all vectors but the query's own row.

    Score is the inner product in double precision; ties go to the smaller id. Vectors (and queries) that are null, empty,
    zero, hold null or non-finite components or have a null id take no part; of repeated ids one result row may appear per
    row. Vectors of another length than the query are no candidates: each length has graphs of its own.
    """
    id_type, id_field = vectors.schema[id_col].dataType, vectors.schema[id_col]
    as_double = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    clean = lambda df: df.where(F.col(id_col).isNotNull() & _sound(vector_col)).select(F.col(id_col).alias("id"), as_double.alias("v"))
    # Equal vectors: the k + 1 smallest ids are all a result can show. Two steps, so that one very common vector is spread.
    smallest = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    parts = 64 + vectors.count() // 50_000
    part = clean(vectors).groupBy("v", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(smallest(F.collect_list("id")).alias("ids"))
    folded = keep(part.groupBy("v").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids")), "vector-groups")
    shards = max(1, -(-folded.count() // shard_rows))
    asked = clean(queries).withColumnRenamed("id", "query_id")
    asked = keep(asked.select("query_id", "v", F.size("v").alias("size")), "vector-queries")
    shard = F.pmod(F.xxhash64("v", F.lit(3)), F.lit(shards)).cast("int")
    # The stated queries go to every shard, in blocks, each of which is one group with the shard's rows.
    block = F.pmod(F.xxhash64("query_id", "v"), F.lit(max(1, -(-asked.count() // 100_000)))).cast("int")
    blocks = asked.withColumn("block", block)
    number = blocks.select("block").distinct()
    left = folded.select("v", "ids", F.size("v").alias("size"), shard.alias("shard"))
    if number.count() > 1:
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number.count() - 1))))
    else:
        left = left.withColumn("block", F.lit(0))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def find(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        kinds = [wanted.schema.field("query_id").type, rows.schema.field("ids").type.value_type, pa.float64()]
        if not rows.num_rows or not wanted.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        size = rows["size"][0].as_py()
        x = np.asarray(rows["v"].combine_chunks().flatten()).reshape(-1, size)
        q = np.asarray(wanted["v"].combine_chunks().flatten()).reshape(-1, size)
        graph, ids, keys = Graph(x), rows["ids"].to_pylist(), wanted["query_id"].to_pylist()
        out = ([], [], [])
        for at in range(0, len(q), AT_ONCE):
            part = q[at : at + AT_ONCE]
            near = graph.nearest(part, max(width, k + 1))
            score = np.einsum("qkd,qd->qk", x[np.maximum(near, 0)], part)
            score = np.where(near >= 0, score, -np.inf)
            order = np.argsort(-score, axis=1, kind="stable")
            for row in range(len(part)):
                key, found = keys[at + row], []
                for c in order[row]:
                    # Equal scores may go on beyond the k-th row; ids decide then, so ties are all looked at.
                    if near[row, c] < 0 or (len(found) >= k and score[row, c] < found[k - 1][0]):
                        break
                    found += [(float(score[row, c]), i) for i in ids[near[row, c]] if i != key]
                    found.sort(key=lambda f: (-f[0], f[1]))
                for s, i in found[:k]:
                    out[0].append(key)
                    out[1].append(i)
                    out[2].append(s)
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    found = left.groupBy("size", "shard", "block").cogroup(right.groupBy("size", "shard", "block")).applyInArrow(find, schema)
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("id").alias("id"), "score"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.id").alias(id_field.name), F.col("b.score").alias("score"))
