"""Steps that read the whole table once: draws of samples and chains, quartiles behind fences."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.draws import Draws
from plumbline.operators import chains, samplers
from plumbline.operators import profile as profile_module
from plumbline.operators.score import CellRules
from plumbline.operators.strata import allocation_table, defect_type_stratum
from plumbline.operators.table import audit


def _numbers(spark, rows=4000):
    return audit(spark.range(rows).selectExpr("id AS k", "double(id * 7919 % 1000) AS x", "CASE WHEN id % 11 > 0 THEN double(id % 97) END AS y"), ["k"], ["x", "y"])


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_chunks_are_counted_from_stored_draws(spark, monkeypatch):
    """F8, F10, F11, F13, F19: the first round of a chain hashes no row again, and its chunks are counted once."""
    written = []
    plain = chains.materialise
    monkeypatch.setattr(chains, "materialise", lambda df, name="table": written.append((name, _plan(df))) or plain(df, name))
    sample = chains.gibbs(_numbers(spark), 0.3, batch_size=100)
    assert sample.n_sampled == 1200 and sample.df.select("k").distinct().count() == 1200
    counted = [plan for name, plan in written if name == "batches"]
    assert len(counted) == 1 and "md5" not in counted[0]


def test_quartiles_of_a_table_serve_every_rule(spark, monkeypatch):
    """F8 to F13, F18, F19: fences of several rules and the profile share one search for quartiles."""
    calls = []
    plain = profile_module.quantile_table
    monkeypatch.setattr(profile_module, "quantile_table", lambda *a, **k: calls.append(1) or plain(*a, **k))
    t = _numbers(spark)
    whole = profile_module.profile_table(t).drop("n_records").first()
    for rule in ("proxy", "tukey"):
        row = profile_module.fences(t.df, t.numeric, rule).first()
        calls.clear()
        assert CellRules.of(t, rule).bounds == tuple((row[f"low_{i}"], row[f"high_{i}"]) for i in range(2))
        assert not calls
    assert whole == profile_module.profile(t.df, t.measured).first()


@pytest.mark.parametrize("likely", [None, 0.0001])
def test_a_sample_hashes_the_table_once(spark, monkeypatch, likely):
    """rows with an early draw are written with it; where they are too few, the table is searched as before."""
    t = _numbers(spark)
    first = {r.k for r in t.df.orderBy(Draws(42).uniform("row", "k")).limit(400).collect()}
    if likely is not None:
        monkeypatch.setattr(samplers, "likely_share", lambda goal, n: likely)
    sample, layered = samplers.random_uniform(t, 0.1), samplers.stratified(t, 0.1, by="column")
    assert {r.k for r in sample.df.collect()} == first and sample.n_sampled == 400
    assert ("md5" in _plan(sample.df)) == ("md5" in _plan(layered.df)) == (likely is not None)
    draw = Window.partitionBy("stratum").orderBy("d")
    ranked = t.df.withColumns({"stratum": defect_type_stratum(t), "d": Draws(42).uniform("row", "k")}).withColumn("rank", F.row_number().over(draw))
    taken = {r.stratum: r.allocated for r in allocation_table(t, 0.1, "column").collect()}
    assert {r.k for r in layered.df.collect()} == {r.k for r in ranked.collect() if r["rank"] <= taken[r.stratum]}
