"""Variants of a table from one overlay against each variant taken by itself."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import audit, profile_table
from plumbline.operators import quantiles
from plumbline.operators.profile import INDICATORS
from plumbline.plans import experiments, overlay
from plumbline.sources.generate import ErrorRates


def _equal_alone(t, mixes, base):
    o = overlay.lay_over(t, [base, *mixes])
    found = overlay.variant_profiles(o, [(0, F.lit(True), base)], [(v, 0, r) for v, r in enumerate(mixes)])
    rows = {r["variant"]: r for r in found.collect()}
    assert sorted(rows) == list(range(len(mixes)))
    for v, rates in enumerate(mixes):
        alone = profile_table(o.damaged(rates, "alone")).first()
        assert rows[v]["sample_size"] == alone["sample_size"]
        for i in INDICATORS:
            assert rows[v][i] == pytest.approx(alone[i], abs=1e-12), (rates, i)
    return rows


MIXES = [ErrorRates(0.0, 0.0, 0.0, 0.0), ErrorRates(0.3, 0.5, 0.3, 0.2), ErrorRates(0.0, 0.5, 0.3, 0.0), ErrorRates(0.3, 0.0, 0.0, 0.2)]


def test_nulls_ties_and_one_hot_content(spark):
    """A third of the rows are equal, some cells and determinants are null, one column is constant and one is all null."""
    df = spark.range(900).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 != 0, F.col("id") % 40).alias("a"),
        F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 11 != 0, (F.col("id") % 40) * 2.0).alias("b"),
        F.lit(5.0).alias("c"), F.lit(None).cast("double").alias("d"), F.when(F.col("id") % 3 != 0, F.col("id") % 5).cast("string").alias("e"))
    t = audit(df, ["id"], ["a", "b", "c", "d", "e"], {"a": "b"}, "ties")
    rows = _equal_alone(t, MIXES, ErrorRates(0.0, 0.0, 0.0, 0.0))
    assert rows[1]["sample_size"] == 1350 and rows[0]["duplicate_rate"] > 0.3
    _equal_alone(t, MIXES[:2], ErrorRates(0.3, 0.5, 0.3, 0.2))  # a base with more damage than its variants


def test_empty_table_and_no_numbers(spark):
    empty = audit(spark.createDataFrame([], "id bigint, a double, b double"), ["id"], ["a", "b"], {"a": "b"}, "empty")
    rows = _equal_alone(empty, MIXES[:2], MIXES[1])
    assert all(r[i] == 0.0 for r in rows.values() for i in INDICATORS)
    words = audit(spark.range(50).select("id", (F.col("id") % 4).cast("string").alias("a")), ["id"], ["a"], None, "words")
    _equal_alone(words, MIXES[:2], MIXES[0])


def test_refuses_what_it_cannot_overlay(spark):
    df = spark.range(5).select("id", F.lit(1.0).alias("a"), F.lit("x").alias("b"))
    with pytest.raises(ValueError):
        overlay.lay_over(audit(df, ["id"], ["a", "b"], {"a": "b"}), MIXES)
    with pytest.raises(ValueError):
        overlay.lay_over(audit(df, ["id"], ["a", "b"], [("a", "a"), ("b", "a")]), MIXES)
    with pytest.raises(ValueError):
        overlay.lay_over(audit(df.withColumn("copy_no", F.lit(1)), ["id"], ["a"]), MIXES)


@pytest.mark.parametrize("few", [4, 65536])
def test_quantiles_of_variants(spark, monkeypatch, few):
    """Several passes and one; variant 1 loses and gains values beyond the range of the base, variant 2 loses all."""
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 7)
    rng = np.random.default_rng(5)
    values = np.round(rng.normal(size=400), 2)
    lost, gained = values[:150], np.round(rng.normal(3, 9, size=90), 2)
    base = spark.createDataFrame([(0, float(v)) for v in values] + [(0, None)], "part int, x double")
    moves = [(1, -1, float(v)) for v in lost] + [(1, 1, float(v)) for v in gained] + [(2, -1, float(v)) for v in values]
    delta = spark.createDataFrame(moves, "variant int, sign int, x double")
    variants = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "variant int, part int")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    found = {r["variant"]: r["x"] for r in quantiles.variant_quantiles(base, delta, variants, ["x"], probs).collect()}
    assert found[0] == pytest.approx(np.quantile(values, probs))
    assert found[1] == pytest.approx(np.quantile(np.concatenate([values[150:], gained]), probs))
    assert found[2] is None


def test_methods_without_a_prefix_run_alone(spark):
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 * 3).cast("double").alias("b"))
    t = audit(df, ["id"], ["a", "b"], {"a": "b"}, "small")
    found = experiments.robustness(t, ["missing", "outlier"], [0.1], ["random_uniform", "importance"], [0.5], [1])
    rows = {(r["error_type"], r["method"]): r for r in found.collect()}
    assert len(rows) == 4 and all(r["n_total"] == 404 and r["n_sampled"] == 202 and 0 <= r["rel_err_mean"] <= 1 for r in rows.values())


def test_methods_that_take_the_same_rows_share_a_part(spark, monkeypatch):
    """Both methods take as many rows of one draw order: one part and one profile a seed and variant, a row of results each."""
    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), F.when(F.col("id") % 9 != 0, F.col("id") % 20 * 3.0).alias("b"))
    t = audit(df, ["id"], ["a", "b"], {"a": "b"}, "small")
    asked, profiles = [], overlay.variant_profiles
    monkeypatch.setattr(overlay, "variant_profiles", lambda o, parts, variants: asked.append((len(parts), len(variants))) or profiles(o, parts, variants))
    kinds, rates, seeds = ["missing", "duplicate"], [0.1, 0.3], [1, 2]
    _, found = overlay.sweep_results(t, kinds, rates, ["random_uniform", "geometric"], [0.5], seeds)
    rows = {(r["error_type"], r["error_rate"], r["method"], r["seed"]): [r[i] for i in INDICATORS] + [r["sample_size"]] for r in found.collect()}
    assert asked == [(1 + 3 * 2, 4 + 4 * 2)] and len(rows) == 2 * 2 * 2 * 2
    assert all(rows[k, r, "random_uniform", s] == rows[k, r, "geometric", s] for k in kinds for r in rates for s in seeds)
