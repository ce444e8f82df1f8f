"""Dependency weights of wide tables by blocks of columns."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import audit
from plumbline.operators.dependency import gram_blocks, pairwise_weights


def _weights(edges):
    return {(r["col_i"], r["col_j"]): r["weight"] for r in edges.collect()}


def test_two_hundred_columns(spark):
    """19,900 pairs against numpy, with a large offset, nulls, a constant and an all-null column."""
    rng = np.random.default_rng(3)
    mixed = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 200)) + rng.normal(size=(300, 200)) + 1e6
    x = mixed.astype(object)
    x[rng.random((300, 200)) < 0.02] = None
    x[:, 7], x[:, 8] = 0.1, None
    names = [f"c{i}" for i in range(200)]
    rows = [(k, *[None if v is None else float(v) for v in r]) for k, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    found = _weights(pairwise_weights(audit(df, ["id"], names)))
    assert len(found) == 200 * 199
    filled = np.array([[0.0 if v is None else v for v in r] for r in x], dtype=float)
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.abs(np.corrcoef(filled, rowvar=False))
    want[7], want[:, 7], want[8], want[:, 8] = 0.0, 0.0, 0.0, 0.0
    for i in range(200):
        for j in range(200):
            if i != j:
                assert found[f"c{i}", f"c{j}"] == pytest.approx(want[i, j], abs=1e-9)


@pytest.mark.parametrize("block", [1, 2, 3])
def test_blocks_equal_one_aggregation(spark, block):
    df = spark.range(200).select("id", *[F.when(F.col("id") % (k + 3) != 0, F.sin(F.col("id") * (k + 1)) * 10**k).alias(f"c{k}") for k in range(4)],
                                 F.lit(0.1).alias("same"))
    t = audit(df, ["id"], [*[f"c{k}" for k in range(4)], "same"])
    one, blocks = _weights(pairwise_weights(t)), _weights(pairwise_weights(t, block))
    assert one.keys() == blocks.keys() and all(blocks[p] == pytest.approx(one[p], abs=1e-12) for p in one)


def test_infinite_values_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, float("inf")), (2, 2.0, 4.0, 1.0), (3, 3.0, 6.5, 2.0)], "id bigint, a double, b double, c double")
    found = _weights(pairwise_weights(audit(df, ["id"], ["a", "b", "c"]), 1))
    assert found["a", "c"] == found["c", "b"] == 0.0 and found["a", "b"] > 0.99
    empty = _weights(pairwise_weights(audit(df.where("id > 9"), ["id"], ["a", "b", "c"]), 1))
    assert all(w == 0.0 for w in empty.values())


def test_sums_of_products(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "a double, b double").repartition(2)
    assert {(r["i"], r["j"]): r["value"] for r in gram_blocks(rows, [1.0, 0.0], 1).collect()} == {(0, 0): 4.0, (0, 1): 10.0, (1, 1): 29.0}
