"""Edge rules of the indicators on small hand-worked tables."""
import math
import re

import pytest
from pyspark.sql import functions as F

from plumbline import audit, profile_table
from plumbline.operators.convergence import all_converged, raftery_lewis, wald_interval
from plumbline.operators.dependency import pairwise_weights
from plumbline.operators.inject import inject_duplicates
from plumbline.operators.profile import mark_violations, profile, row_flags
from plumbline.operators.score import error_proxy


def rates(df, rules=None, **options):
    r = profile_table(audit(df, rules=rules), **options).first()
    return r["missing_rate"], r["duplicate_rate"], r["outlier_rate"], r["inconsistency_rate"]


def test_empty_table(spark):
    assert rates(spark.createDataFrame([], "a double, b string"), {"a": "b"}) == (0.0, 0.0, 0.0, 0.0)


def test_nan_counts_as_missing_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(1.0, "x"), (math.nan, "y"), (None, "y"), (0.0, None), (-0.0, None), (5.0, "z")], "a double, b string")
    missing, duplicate, _, _ = rates(df)
    assert missing == pytest.approx(4 / 12)
    assert duplicate == pytest.approx(4 / 6)


def test_swapped_nulls_are_not_duplicates(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert rates(df)[1] == 0.0
    assert rates(df, exact_rows=True)[1] == 0.0


def test_zero_iqr_uses_deviation(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(19)] + [(19, 100.0)], "id int, v double")
    assert profile(df.select("v"), ["v"]).first()["outlier_rate"] == pytest.approx(1 / 20)


def test_fewer_than_four_values_give_no_outliers(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (900.0,)], "v double")
    assert rates(df)[2] == 0.0


def test_fd_nulls(spark):
    rows = [(None, "p"), (None, "q"), ("k", "p"), ("k", "q"), ("k", None), ("m", "p"), ("m", None), ("n", "p")]
    df = spark.createDataFrame(rows, "det string, dep string")
    assert rates(df, {"det": "dep"})[3] == pytest.approx(3 / 8)  # all three rows of k, the one without a dependent included
    flags = row_flags(audit(df, rules={"det": "dep"}))
    assert flags.where("is_inconsistent").count() == 3


def test_rule_on_missing_column_is_skipped(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "x string, y int")
    assert rates(df, {"x": "absent"})[3] == 0.0


def test_no_numeric_column(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "x string")
    assert rates(df)[2] == 0.0
    assert {r["score"] for r in error_proxy(audit(df)).collect()} == {0.0}


def test_constant_column_has_weight_zero(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "a double, b double")
    assert {r["weight"] for r in pairwise_weights(audit(df)).collect()} == {0.0}


def test_hot_determinant_and_hot_row(spark):
    """A third of the rows share one key; marking must still be exact."""
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id as string) end as k",
                                      "case when id % 3 = 0 then 'same' else cast(id as string) end as v", "id % 2 as side")
    t = audit(df, ["id"], ["k", "v", "side"], [("k", "side"), ("v", "k")])
    r = profile_table(t).first()
    assert r["inconsistency_rate"] == pytest.approx(1 / 3)
    assert r["duplicate_rate"] == pytest.approx(1 / 3)
    flags = row_flags(t)
    assert flags.where("is_inconsistent").count() == 1000
    assert flags.where("is_duplicate").count() == 1000


def test_unknown_confidence_is_rejected(spark):
    with pytest.raises(ValueError):
        wald_interval(spark.createDataFrame([(0.1, 5)], "value double, sample_size long"), confidence=0.5)


def test_chains(spark):
    rows = [("constant", i, 1.0) for i in range(60)] + [("short", i, float(i)) for i in range(10)]
    rows += [("mixing", i, float((i * 37) % 60)) for i in range(60)]
    rows += [("stuck", i, float(59 - i) if i < 59 else -1.0) for i in range(60)]
    found = {r["indicator"]: r for r in raftery_lewis(spark.createDataFrame(rows, "indicator string, step long, value double")).collect()}
    assert found["constant"]["converged"] and found["constant"]["message"] == "constant chain"
    assert not found["short"]["converged"] and found["short"]["n_required"] == 100
    assert found["stuck"]["burn_in"] is None
    only_short = raftery_lewis(spark.createDataFrame(rows[60:70], "indicator string, step long, value double"))
    assert all_converged(only_short).first()["all_converged"] is False


def test_null_groups_stay(spark):
    rows = [(g, float(k % 7), "x") for k, g in enumerate(["a", "b", None, None] * 10)]
    df = spark.createDataFrame(rows, "g string, v double, t string")
    got = {r["g"]: r["sample_size"] for r in profile(df, ["v", "t"], group=["g"]).collect()}
    assert got == {"a": 10, "b": 10, None: 20}
    assert mark_violations(df, {"t": "v"}, "broken", ["g"]).where("broken").count() == 40


def test_one_indicator_needs_no_shuffle_of_rows(spark):
    df = spark.createDataFrame([(1.0, "a", "p"), (None, "a", "q"), (math.nan, "b", "r")], "v double, t string, u string")
    one = profile(df, rules={"t": "u"}, indicators=["missing_rate"])
    assert one.columns == ["missing_rate", "sample_size"] and one.first()["missing_rate"] == pytest.approx(2 / 9)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    whole = profile(df, rules={"t": "u"})._jdf.queryExecution().executedPlan().toString()
    assert not any(re.search(r"hashpartitioning\((t|u)#", line) for line in whole.split("\n"))


@pytest.mark.parametrize("kind", ["violating", "clean", "null"])
def test_a_hot_determinant_spreads(spark, kind):
    """Half of the rows have one determinant; no partition of the join holds more than twice its share."""
    hot = "CAST(NULL AS STRING)" if kind == "null" else "'hot'"
    dependent = "id % 2" if kind == "violating" else "0"
    df = spark.sql(f"SELECT id, CASE WHEN id % 2 = 0 THEN {hot} ELSE CAST(id AS STRING) END AS d, CASE WHEN id % 2 = 0 THEN {dependent.replace('id', 'id div 2')} ELSE 0 END AS v FROM range(40000)")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "16", "-1")):
            spark.conf.set(k, v)
        marked = mark_violations(df, {"d": "v"}, "broken")
        sizes = [r["n"] for r in marked.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("broken")).collect()]
        assert marked.where("broken").count() == (20_000 if kind == "violating" else 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(sizes) <= 2 * 40_000 / 16 and len(sizes) == 16


def test_many_copies_of_one_row(spark):
    copies = inject_duplicates(spark.createDataFrame([(1, "x")], "k int, v string"), 0, ["k"], copies=500)
    assert copies.count() == 501 and copies.select("copy_no").distinct().count() == 501
