"""Steps that must not grow faster than the table: many copies of a row, cheap draws, nested samples, several determinants."""
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions.draws import Draws
from plumbline.operators import inject, nested
from plumbline.operators.profile import profile
from plumbline.operators.table import audit
from plumbline.plans import progressive


def _draw(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def test_copies_beyond_one_block_arrive_in_order(spark):
    """A row carries the gaps of one block of copies, not of all of them; sums equal those in one go."""
    source = spark.range(7).withColumn("gaps", F.lit("a column of the table"))
    arrived, _ = inject.copy_arrivals(source, 7, 700, ["id"], 5)
    found = {(r["id"], r["copy_no"]): (r["arrival"], r["gaps"]) for r in arrived.collect()}
    for i in range(7):
        at = 0.0
        for j in range(1, 101):
            at += -math.log(_draw(f"5|copy{j}|{i}") + 2.0**-53)
            if (i, j) in found:
                assert found[i, j][0] == pytest.approx(at, rel=1e-13) and found[i, j][1] == "a column of the table"
            else:
                assert at > 130
    assert inject.inject_duplicates(source, 100, ["id"], 5).count() == 707


def test_below_equals_the_comparison_of_numbers(spark):
    draws, rows = Draws(3), spark.range(3000)
    edge = _draw("3|t|17")
    for share in (0.05, edge, math.nextafter(edge, 1.0), 1.0 - 2.0**-53, 2.0**-60, 0.0, 1.0, 2.0, -1.0):
        assert rows.where(draws.below(share, "t", "id") != (draws.uniform("t", "id") < share)).count() == 0


RULES = [("a", "b"), (("b", "c"), "x")]


@pytest.mark.parametrize("rules, few", [((), 10**6), (RULES[:1], 4), (RULES, 16_384), (RULES[1:], 4)])
def test_nested_samples_equal_samples_alone(spark, monkeypatch, rules, few):
    monkeypatch.setattr(nested, "FEW", few)
    rows = spark.range(1500).select(
        (F.col("id") % 2).cast("int").alias("seed"), F.least(F.pmod(F.xxhash64("id"), F.lit(12)), F.lit(8)).cast("int").alias("level"),
        F.expr("nullif(pmod(xxhash64(id, 1), 9), 3)").alias("a"), F.expr("nullif(pmod(xxhash64(id, 2), 3), 1)").alias("b"),
        F.expr("if(pmod(xxhash64(id, 3), 7) = 0, null, 'c' || pmod(xxhash64(id, 3), 5))").alias("c"),
        F.expr("if(id % 11 = 0, 900.0, pmod(xxhash64(id, 4), 40) / 8D)").alias("x"), F.expr("if(level = 0 or id % 50 = 7, null, 1.5D)").alias("y"))
    rows = rows.unionByName(rows.where("a = 4 and level > 5")).where("not (seed = 1 and level < 2)")
    columns = ["a", "b", "c", "x", "y"]
    found = {(r["seed"], r["step"]): r for r in nested.nested_profile(rows, 10, columns, rules, held=1500).collect()}
    alone = rows.withColumn("step", F.explode(F.sequence("level", F.lit(9))))
    wanted = profile(alone, columns, rules, group=["seed", "step"], rows=10**9).collect()
    assert len(wanted) == len(found) == 18
    for r in wanted:
        assert found[r["seed"], r["step"]].asDict() == pytest.approx(r.asDict(), abs=1e-12)


def test_a_curve_writes_a_row_once_per_seed(spark, monkeypatch):
    """It was written once per budget that holds it."""
    written = []
    keep = progressive.materialise
    monkeypatch.setattr(progressive, "materialise", lambda df, name: written.append(keep(df, name)) or written[-1])
    t = audit(spark.range(400).selectExpr("id", "id % 7 as v"), ["id"], ["v"])
    curve = progressive.progressive_curve(t, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0, 1.0], [1, 2])
    assert sorted(r["sample_size"] for r in curve.where("seed = 1").collect()) == [1, 40, 80, 120, 160, 200, 400, 400]
    assert written[0].count() == 800


def test_rules_of_two_determinants_mark_counts_not_rows(spark, monkeypatch):
    """Whole rows went through one join per determinant, and the first join ran again for the second."""
    from plumbline.operators import profile as module

    joined = []
    keep = module.mark_keys
    monkeypatch.setattr(module, "mark_keys", lambda df, *rest: joined.append(df.count()) or keep(df, *rest))
    rows = spark.range(4000).selectExpr("nullif(id % 7, 3) as a", "id % 7 % 3 as b", "if(id % 5 = 0, id % 2, 9) as c", "id % 5 as e", "id % 2 as g", "id as unique")
    found = profile(rows, ["a", "b", "c", "e", "unique"], [("a", "b"), ("e", "c")], group=["g"], indicators=["inconsistency_rate"]).collect()
    assert [r["inconsistency_rate"] for r in found] == [0.0, 0.0] and max(joined) < 100
    rows = rows.drop("g")
    whole = profile(rows, ["a", "b", "c", "e"], [("a", "b"), ("e", "c")], indicators=["inconsistency_rate"]).first()
    assert whole["inconsistency_rate"] == pytest.approx(0.2) and whole["sample_size"] == 4000


@pytest.mark.parametrize("rules", [[(("a", "b"), "x")], [("a", "b"), ("b", "x")], []])
def test_samples_that_share_rows_are_profiled_together(spark, rules):
    """A row was shuffled once per sample that holds it."""
    from plumbline.operators.profile import profile_held
    rows = spark.range(900).selectExpr(
        "nullif(pmod(xxhash64(id, 1), 9), 3) as a", "nullif(pmod(xxhash64(id, 2), 4), 1) as b", "if(id % 13 = 0, 900.0, pmod(xxhash64(id, 3), 5) / 4D) as x",
        "pmod(xxhash64(id, 4), 16) as word", "1.0D + pmod(xxhash64(id, 5), 3) as weight").where("word > 0")
    rows = rows.unionByName(rows.where("a = 4"))
    held = {k: F.col("word").bitwiseAND(F.lit(1 << k)) != 0 for k in range(4)} | {4: F.lit(False)}
    weights = {(k, ""): None for k in held} | {(3, "even"): F.col("weight"), (4, "even"): F.col("weight")}
    found = {(r["k"], r["tag"]): r.asDict() for r in profile_held(rows, ["a", "b", "x"], rules, held, weights, "k", "tag").collect()}
    assert len(found) == 5
    for (k, tag), r in found.items():
        alone = profile(rows.where(held[k]), ["a", "b", "x"], rules, "weight" if tag else None).first().asDict()
        assert {c: r[c] for c in alone} == pytest.approx(alone, abs=1e-9)


def test_only_rows_near_chosen_blocks_are_sorted(spark, monkeypatch):
    """The whole table was sorted for the positions of a few blocks."""
    from plumbline.operators import table as module
    written = []
    keep = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.append(keep(df, name)) or written[-1])
    monkeypatch.setattr(module, "NEAR_ROWS", 0)
    df = spark.range(4000).selectExpr("id", "case when id % 40 = 0 then null when id % 10 = 1 then 50.5D else pmod(id * 7919, 3989) / 4D end as o")
    t = audit(df, ["id"])
    chosen = F.col("__block").isin(0, 17, 49, 63)
    found = module.ordinals_of_blocks(t, ["o"], 63, 64, [chosen], rows_per_range=300)
    assert found.count() == 4000 == found.select("id").distinct().count() and written[-1].count() < 1200
    known = {r["id"]: r["ordinal"] for r in found.where("ordinal is not null").collect()}
    wanted = {r["id"]: r["ordinal"] for r in module.with_ordinal(t, ["o"])[0].collect()}
    assert all(wanted[i] == at for i, at in known.items())
    assert {i for i, at in wanted.items() if at // 63 in (0, 17, 49, 63)} <= set(known)
    flat = audit(df.selectExpr("id", "1 as o"), ["id"])  # no two bounds: all rows are sorted
    assert module.ordinals_of_blocks(flat, ["o"], 63, 64, [chosen]).where("ordinal is null").isEmpty()


def test_membership_writes_the_rows_a_sample_may_hold(spark, monkeypatch):
    """All rows were written, with a draw per method."""
    from plumbline.plans import membership as module
    written = {}
    keep = module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    t = audit(spark.range(5000).selectExpr("id", "if(id % 9 = 0, null, id % 31) as v"), ["id"], ["v"])
    found = module.membership(t, ["random_uniform", "importance", "stratified_column", "cluster"], [0.02, 0.05], [1])
    assert written["membership"].count() < 1500
    assert [size for *_, size in found.conditions] == [100, 250] * 4
    assert sorted(r["n_sampled"] for r in found.profile().collect()) == [100] * 4 + [250] * 4
    assert {r["n_records"] for r in found.profile().collect()} == {5000}


def test_a_dependency_apart_gives_the_same_rate(spark):
    rows = spark.range(600).selectExpr("nullif(id % 7, 3) as a", "if(id % 14 = 1, id % 4, id % 7) as b", "id % 5 as c")
    whole = profile(rows, ["a", "b", "c"], [("a", "b"), ("a", "c")]).first()
    assert profile(rows, ["a", "b", "c"], [("a", "b"), ("a", "c")], apart=True).first() == whole and whole["inconsistency_rate"] > 0.5


def test_sampled_rows_bring_their_columns_along(spark):
    """The table was joined to the sampled keys; only repeated keys need that, and rows without a whole key are in no join."""
    from plumbline.operators.table import identified
    from plumbline.plans.replay import LABEL, replay
    df = spark.range(400).selectExpr("id", "if(id % 50 = 3, null, 'k') as k", "if(id % 9 = 0, null, id % 31) as start")
    for rows in (df, df.unionByName(df.where("id = 7 or id = 3"))):
        t = audit(rows, ["id", "k"], ["start"])
        found = replay(t, [0.9], [1], "metropolis_hastings", batch_size=40)
        joins = "Join" in found.rows._jdf.queryExecution().optimizedPlan().toString() or not identified(t)
        assert joins == (rows is not df) and found.rows.columns == ["id", "k", "start", LABEL]
        assert found.rows.where("k is null").isEmpty() and found.conditions[0][4] == int(rows.count() * 0.9)
        assert found.rows.join(df.withColumnRenamed("start", "was"), ["id", "k"]).where("not (start <=> was)").isEmpty()
        copies = found.rows.where("id = 7").count()
        assert copies in ((0, 1) if rows is df else (0, 2, 4))
