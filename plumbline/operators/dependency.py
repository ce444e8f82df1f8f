"""Dependency weights between columns (absolute correlation) and the column priorities derived from them."""
from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double
from .storage import materialise, small_table
from .table import AuditTable

EDGES = "col_i string, col_j string, weight double"
BLOCK = 24  # columns of a block, and of a table whose pairs are one aggregation
EMITTED = 65536  # entries of the matrix in a batch


def pairwise_weights(t: AuditTable, block: int = BLOCK) -> DataFrame:
    """Edges ``(col_i, col_j, weight)`` in both directions for every pair of numeric columns.

    The weight is |Pearson| with nulls as 0; a constant column, or one with an infinite value, has weight 0.  Up to ``block``
    columns one aggregation computes all pairs.  Beyond, where an aggregate per pair would outgrow a plan, the Gram matrix is
    summed up in blocks of columns (:func:`gram_blocks`).
    """
    columns = t.numeric
    if len(columns) < 2:
        return t.df.sparkSession.createDataFrame([], EDGES)
    filled = t.df.select(*[F.coalesce(as_double(c), F.lit(0.0)).alias(f"x_{i}") for i, c in enumerate(columns)])
    if len(columns) > block:
        return _edges_of_gram(filled, columns, block)
    pairs = list(combinations(range(len(columns)), 2))
    sums = [F.stddev_pop(f"x_{i}").alias(f"sd_{i}") for i in range(len(columns))]
    sums += [F.covar_pop(f"x_{i}", f"x_{j}").alias(f"cov_{i}_{j}") for i, j in pairs]
    stats = filled.agg(*sums)
    edges = []
    for i, j in pairs:
        weight = F.coalesce(F.abs(F.col(f"cov_{i}_{j}") / F.nullif(F.col(f"sd_{i}") * F.col(f"sd_{j}"), F.lit(0.0))), F.lit(0.0))
        weight = F.when(F.isnan(weight), 0.0).otherwise(weight)
        for a, b in ((i, j), (j, i)):
            edges.append(F.struct(F.lit(columns[a]).alias("col_i"), F.lit(columns[b]).alias("col_j"), weight.alias("weight")))
    return stats.select(F.inline(F.array(*edges)))


def gram_blocks(rows: DataFrame, shift: Sequence[float], block: int = BLOCK) -> DataFrame:
    """``(i, j, value)`` for i <= j: sums over all rows of the products of columns i and j, each less its ``shift``.

    ``rows`` has only double columns without nulls.  A task multiplies its rows batch by batch, one pair of column blocks at a time,
    and keeps one matrix of k * k doubles; it emits the matrix once, and the entries of all tasks are added by key.
    """
    k, at = len(shift), np.asarray(shift)
    starts = list(range(0, k, block))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - at
            with np.errstate(invalid="ignore", over="ignore"):
                for a in starts:
                    for b in starts[starts.index(a):]:
                        gram[a:a + block, b:b + block] += x[:, a:a + block].T @ x[:, b:b + block]
        upper = np.triu_indices(k)
        for lo in range(0, len(upper[0]), EMITTED):
            i, j = (u[lo:lo + EMITTED] for u in upper)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(gram[i, j])], ["i", "j", "value"])

    return rows.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def _edges_of_gram(filled: DataFrame, columns: Sequence[str], block: int) -> DataFrame:
    """Correlations from the Gram matrix about the means; the row of means and ranges is as wide as the schema."""
    x = filled.columns
    ranges = filled.agg(*[f(c).alias(f"{name}_{c}") for c in x for name, f in (("avg", F.avg), ("min", F.min), ("max", F.max))]).first()
    usable = [ranges[f"min_{c}"] is not None and math.isfinite(ranges[f"min_{c}"]) and math.isfinite(ranges[f"max_{c}"])
              and ranges[f"min_{c}"] < ranges[f"max_{c}"] for c in x]
    gram = materialise(gram_blocks(filled, [ranges[f"avg_{c}"] if ok else 0.0 for c, ok in zip(x, usable)], block), "gram")
    own = gram.where("i = j").select(F.col("i").alias("at"), F.col("value").alias("square"))
    names = small_table(filled.sparkSession, [(i, c, ok) for i, (c, ok) in enumerate(zip(columns, usable))], "at int, col string, usable boolean")
    sides = F.broadcast(names.join(own, "at", "left"))  # as many rows as columns
    both = gram.where("i < j")
    for s in "ij":
        both = both.join(sides.withColumnsRenamed({"at": s, "col": f"col_{s}", "usable": f"usable_{s}", "square": f"square_{s}"}), s)
    weight = F.abs(F.col("value") / F.nullif(F.sqrt("square_i") * F.sqrt("square_j"), F.lit(0.0)))
    weight = F.when(F.col("usable_i") & F.col("usable_j"), F.nanvl(weight, F.lit(0.0)))
    found = both.select("col_i", "col_j", F.coalesce(weight, F.lit(0.0)).alias("weight"))
    return found.unionByName(found.select(F.col("col_j").alias("col_i"), F.col("col_i").alias("col_j"), "weight"))


def constant_weights(t: AuditTable, weight: float | Mapping[tuple[str, str], float]) -> DataFrame:
    """Given weights instead of fitted ones: one number for all pairs of measured columns, or a mapping of pairs."""
    if isinstance(weight, Mapping):
        rows = [(a, b, float(w)) for (a, b), w in weight.items()]
    else:
        rows = [(a, b, float(weight)) for a in t.measured for b in t.measured if a != b]
    return small_table(t.df.sparkSession, rows, EDGES)


def error_affinity(t: AuditTable, is_error: Column | None = None) -> DataFrame:
    """(col, affinity): how far a column's mean moves between flagged and other rows, in sample deviations.

    1 + |mean_err - mean_ok| / (sd + 1e-9) for numeric columns, 1/n for the others, normalised to sum 1; without a
    flag, or if no row is flagged, 1/n for all.
    """
    share = 1.0 / max(len(t.measured), 1)
    if is_error is None:
        rows = [(c, share) for c in t.measured]
        return small_table(t.df.sparkSession, rows, "col string, affinity double")
    flag = F.coalesce(is_error, F.lit(False))
    sums = [F.count_if(flag).alias("flagged"), F.count_if(~flag).alias("clear")]
    for i, c in enumerate(t.numeric):
        x = as_double(c)
        sums += [F.avg(F.when(flag, x)).alias(f"bad_{i}"), F.avg(F.when(~flag, x)).alias(f"ok_{i}"), F.stddev_samp(x).alias(f"sd_{i}")]
    stats = t.df.agg(*sums)
    raw = []
    for c in t.measured:
        if c in t.numeric:
            i = t.numeric.index(c)
            # a side without rows counts as mean 0
            bad = F.when(F.col("flagged") > 0, F.col(f"bad_{i}")).otherwise(F.lit(0.0))
            ok = F.when(F.col("clear") > 0, F.col(f"ok_{i}")).otherwise(F.lit(0.0))
            moved = 1.0 + F.abs(bad - ok) / (F.col(f"sd_{i}") + 1e-9)
            value = F.when(F.col("flagged") > 0, moved).otherwise(F.lit(share))
        else:
            value = F.lit(share)
        raw.append(F.struct(F.lit(c).alias("col"), value.alias("raw")))
    total = F.aggregate("pairs", F.lit(0.0), lambda acc, p: acc + p["raw"])
    listed = stats.select(F.array(*raw).alias("pairs")).withColumn("total", total)
    return listed.select(F.explode("pairs").alias("p"), "total").select("p.col", (F.col("p.raw") / F.col("total")).alias("affinity"))


def column_priority(t: AuditTable, edges: DataFrame, affinity: DataFrame | None = None) -> DataFrame:
    """(col, priority): summed weights plus affinity, normalised over all measured columns; uniform if that fails."""
    affinity = error_affinity(t) if affinity is None else affinity
    degree = edges.groupBy(F.col("col_i").alias("col")).agg(F.sum(F.nanvl("weight", F.lit(0.0))).alias("degree"))
    joined = affinity.join(F.broadcast(degree), "col", "left")
    joined = joined.withColumn("raw", F.coalesce("degree", F.lit(0.0)) + F.col("affinity"))
    return _normalised(joined, len(t.measured), "priority")


def neighbourhood_weights(t: AuditTable, edges: DataFrame, column: str, affinity: DataFrame | None = None) -> DataFrame:
    """(col, weight): weights of one column's neighbours plus affinity, normalised."""
    affinity = error_affinity(t) if affinity is None else affinity
    near = edges.where(F.col("col_i") == column).select(F.col("col_j").alias("col"), F.col("weight").alias("degree"))
    joined = affinity.join(F.broadcast(near), "col", "left")
    joined = joined.withColumn("raw", F.coalesce("degree", F.lit(0.0)) + F.col("affinity"))
    return _normalised(joined, len(t.measured), "weight")


def _normalised(df: DataFrame, n: int, alias: str) -> DataFrame:
    total = df.agg(F.sum("raw").alias("total"))
    usable = (F.col("total") != 0) & (F.abs("total") < F.lit(float("inf")))
    value = F.when(usable, F.col("raw") / F.nullif(F.col("total"), F.lit(0.0))).otherwise(F.lit(1.0 / max(n, 1)))
    return df.crossJoin(F.broadcast(total)).select("col", value.alias(alias))


def pivot_distribution(priority: DataFrame, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Priorities of the numeric columns, renormalised; empty if their total is not positive (schema-sized)."""
    found = {r["col"]: r["priority"] or 0.0 for r in priority.collect()}
    kept = [(c, found[c]) for c in columns if c in found]
    total = sum(p for _, p in kept)
    return [(c, p / total) for c, p in kept] if total > 0 else []
