"""Sizes, identity, nesting and stability of samples; statistics over many seeds."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import audit, draw_sample, profile_table
from plumbline.operators.score import error_proxy
from plumbline.checks.base import DIRTY_KEY, dirty_lines
from plumbline.operators import chains, inject, quantiles, selection, strata
from plumbline.operators.samplers import geometric_batches, geometric_size, yamane_size
from plumbline.operators.table import audit as audit_table, number_copies, with_ordinal
from plumbline.functions import Draws


@pytest.fixture(scope="module")
def table(spark, folder):
    return dirty_lines(spark, folder)


METHODS = ["random_uniform", "geometric", "cluster", "importance", "stratified_column", "stratified_quality"]


@pytest.mark.parametrize("method", METHODS)
def test_exact_size_and_distinct_rows(table, method):
    sample = draw_sample(method, table, 0.1)
    keys = sample.df.select(*table.key_cols)
    assert sample.n_sampled == keys.count() == keys.distinct().count()
    assert sample.n_sampled == int(table.rows * 0.1)


@pytest.mark.parametrize("method", ["metropolis_hastings", "gibbs", "dag", "dag_uniform"])
def test_chain_sizes(table, method):
    sample = draw_sample(method, table, 0.2, batch_size=100)
    assert sample.n_sampled == int(table.rows * 0.2) == sample.df.select(*table.key_cols).distinct().count()
    assert sample.df.agg(F.sum("w")).first()[0] == pytest.approx(1.0)


def test_chain_takes_everything_over_several_rounds(table):
    sample = chains.metropolis_hastings(table, 1.0, batch_size=200)
    assert sample.n_sampled == table.rows == sample.df.count()
    assert sample.df.select(*table.key_cols).exceptAll(table.df.select(*table.key_cols)).count() == 0


def test_segments_do_not_change_a_chain(table):
    """The batch is as given, however many steps that takes, and the segment length has no say."""
    runs = [chains.metropolis_hastings(table, 0.5, batch_size=10, segment=n) for n in (7, 4096)]
    keys = [r.df.select(*table.key_cols) for r in runs]
    assert keys[0].exceptAll(keys[1]).isEmpty() and runs[0].n_sampled == runs[1].n_sampled == int(table.rows * 0.5)
    assert runs[0].n_steps == runs[1].n_steps > 7 and runs[0].acceptance_rate == runs[1].acceptance_rate
    other = chains.metropolis_hastings(table, 0.5, batch_size=40, segment=7)
    assert other.n_steps < runs[0].n_steps and not other.df.select(*table.key_cols).exceptAll(keys[0]).isEmpty()


def test_many_segments_are_folded_in_a_few_jobs(spark, table):
    """All segments are folded at once; the number of jobs does not grow with them."""
    counts = {}
    for segment in (2, 4096):
        group = f"chain in segments of {segment}"
        spark.sparkContext.setJobGroup(group, group)
        sample = chains.metropolis_hastings(table, 0.5, batch_size=4, segment=segment)
        counts[segment] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("other", "other")
    assert sample.n_steps > 500  # over 250 segments of two steps
    assert counts[2] - counts[4096] < 40


def test_chain_behaves_like_a_plain_sequential_one(table):
    """Acceptance and mean score against a chain that draws batches one after the other from one pool."""
    scores = np.array([r["score"] for r in error_proxy(table).select("score").collect()])
    goal, batch, accepted, means = int(len(scores) * 0.3), 50, [], []
    for seed in range(20):
        rng = np.random.default_rng(seed)
        weight = (scores + 1e-6) / (scores + 1e-6).sum()
        taken = rng.choice(len(scores), batch, replace=False, p=weight)
        pool = rng.permutation(np.setdiff1d(np.arange(len(scores)), taken))
        total, n, steps, yes = scores[taken].sum(), batch, 0, 0
        while n < goal and len(pool):
            offer = pool[:batch]
            ok = np.log(rng.random() + 1e-12) < 2.0 * (scores[offer].mean() - total / n)
            used = offer if ok else pool[: batch // 4]
            total, n, steps, yes, pool = total + scores[used].sum(), n + len(used), steps + 1, yes + ok, rng.permutation(pool[len(used):])
        accepted.append(yes / steps)
        means.append(total / n)
    ours = [chains.metropolis_hastings(table, 0.3, seed=s, batch_size=batch) for s in (1, 2, 3)]
    assert abs(np.mean([o.acceptance_rate for o in ours]) - np.mean(accepted)) < 0.08
    mine = [error_proxy(table).join(o.df.select(*table.key_cols), list(table.key_cols), "left_semi").agg({"score": "avg"}).first()[0] for o in ours]
    assert abs(np.mean(mine) - np.mean(means)) < 0.15 * np.mean(means)


def test_nesting_and_full_budget(table):
    small, large = draw_sample("random_uniform", table, 0.05), draw_sample("random_uniform", table, 0.2)
    assert small.df.select(*DIRTY_KEY).exceptAll(large.df.select(*DIRTY_KEY)).count() == 0
    assert draw_sample("random_uniform", table, 1.0).profile().first() == profile_table(table, n_records=table.rows).first()


def test_partitioning_does_not_matter(table):
    shuffled = table.with_rows(table.df.repartition(7, "l_tax"))
    for method in ("random_uniform", "importance"):
        a, b = draw_sample(method, table, 0.1).df.select(*DIRTY_KEY), draw_sample(method, shuffled, 0.1).df.select(*DIRTY_KEY)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_unknown_method(table):
    with pytest.raises(ValueError):
        draw_sample("nonesuch", table, 0.1)
    with pytest.raises(ValueError):
        draw_sample("exhaustive", table, 0.1)


def test_size_formulas():
    for n in (1, 2, 7, 10, 100, 1023, 1024, 6120):
        assert geometric_size(n, 1.0) == (geometric_batches(n, 1.0) or [0])[-1]
    assert yamane_size(10**9) == 399 and yamane_size(1) == 1


def test_deep_refinement_of_the_cutoff(spark, monkeypatch):
    monkeypatch.setattr(selection, "FINE_ROWS", 0)
    df = spark.range(20000)
    draw = Draws(3).uniform("row", "id")
    _, cut = selection.smallest(df, draw, ["id"], lambda n: 777)
    expected = {r["id"] for r in df.orderBy(draw, "id").limit(777).collect()}
    assert {r["id"] for r in df.where(cut.keeps(draw, ["id"])).collect()} == expected


def test_tied_draws_follow_the_key(spark):
    df = spark.range(100)
    _, cut = selection.smallest(df, F.lit(0.25), ["id"], lambda n: 10)
    assert cut.tied
    assert sorted(r["id"] for r in df.where(cut.keeps(F.lit(0.25), ["id"])).collect()) == list(range(10))


@pytest.mark.parametrize("small", [10, 1000, quantiles.SMALL_BIN])
def test_quantiles_equal_percentile(spark, folder, monkeypatch, small):
    """The same numbers from narrowing by bins, by value, and without looking at the targets."""
    monkeypatch.setattr(quantiles, "SMALL_BIN", small)
    df = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_quantity", "l_extendedprice", "nullif(l_returnflag, 'A') as flag", "cast(null as double) as none",
                                                                    "case l_linenumber when 1 then double('inf') when 2 then 1e308 when 3 then -1e308 else l_tax end as wild")
    probs, columns = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0], ["l_quantity", "l_extendedprice", "none", "wild"]
    for group in ([], ["flag"]):
        want = df.groupBy(*group).agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in columns])
        got = quantiles.quantile_table(df, columns, probs, group, rows=None if small < 10**6 else 6000)
        key = lambda r: str(r["flag"]) if group else ""
        for a, b in zip(sorted(want.collect(), key=key), sorted(got.collect(), key=key), strict=True):
            for c in columns:
                assert b[c] == (None if a[c] is None else pytest.approx(a[c], rel=1e-12)), (group, c)
    assert quantiles.quantile_table(df.limit(0), ["l_quantity"], probs).first()["l_quantity"] is None
    assert quantiles.quantile_table(df.limit(0), ["l_quantity"], probs, ["flag"]).count() == 0


def test_quantiles_of_one_hot_value(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL_BIN", 100)
    df = spark.range(50000).selectExpr("case when id % 3 = 0 then 7.0D else cast(id as double) end as v")
    assert quantiles.quantile_table(df, ["v"], [0.1, 0.5]).first()["v"] == df.selectExpr("percentile(v, array(0.1, 0.5)) as v").first()["v"]


def test_copies_of_a_hot_row_are_numbered(spark, monkeypatch):
    import plumbline.operators.table as table_module
    monkeypatch.setattr(table_module, "COPIES_PER_TASK", 7)
    df = spark.range(300).selectExpr("case when id < 100 then 'hot' else cast(id as string) end as x")
    numbered = number_copies(df)
    assert numbered.count() == 300 == numbered.select("row_h1", "row_h2", "row_copy").distinct().count()
    assert sorted(r["row_copy"] for r in numbered.where("x = 'hot'").collect()) == list(range(1, 101))


def test_ordinal_with_a_hot_order_value(spark):
    df = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 5 else id % 11 end as o")
    ordered, n = with_ordinal(audit_table(df, ["id"]), ["o"], rows_per_range=100)
    got = [r["id"] for r in ordered.orderBy("ordinal").collect()]
    assert n == 4000 and got == [r["id"] for r in df.orderBy("o", "id").collect()]
    assert ordered.agg(F.countDistinct("ordinal")).first()[0] == 4000


def test_hundreds_of_ranges(spark):
    """Offsets come from a two-level table; no array of bounds is carried by the rows."""
    df = spark.range(1200).selectExpr("id", "case when id % 5 = 0 then null else (id * 7919) % 997 end as o", "'x' as ordinal_of")
    want = [r["id"] for r in df.orderBy("o", "id").collect()]
    ordered, n = with_ordinal(audit_table(df, ["id"]), ["o"], rows_per_range=3)
    assert n == 1200 and [r["id"] for r in ordered.orderBy("ordinal").collect()] == want
    plan = ordered._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and len(plan) < 20_000
    assert with_ordinal(audit_table(df.limit(0), ["id"]), ["o"])[0].count() == 0


def test_running_totals_in_two_levels(spark):
    from plumbline.operators.prefix import totals_before
    df = spark.range(1000).selectExpr("id * 2 as at", "id % 7 as v", "case when id % 3 = 0 then null else 1L end as w")
    rows = sorted(totals_before(df, "at", ["v", "w"], block=64).collect())
    v = w = 0
    for r in rows:
        assert (r["before_v"], r["before_w"]) == (v, w)
        v, w = v + r["v"], w + (r["w"] or 0)


def test_membership_equals_single_samples(spark, table):
    """The bits of every condition mark just the rows that the method draws alone, and the scan of the source is one."""
    from plumbline.plans.membership import CHAIN_FREE, membership
    tagged = membership(table, CHAIN_FREE, [0.03, 0.2], [42])
    for k, method, budget, seed, size in tagged.conditions:
        alone = draw_sample(method, table, budget, seed)
        held = tagged.rows.where(F.col(f"word_{k // 62}").bitwiseAND(F.lit(1 << (k % 62))) != 0).select(*table.key_cols)
        assert alone.n_sampled == size == held.count(), method
        assert held.exceptAll(alone.df.select(*table.key_cols)).isEmpty(), method
    assert tagged.exploded()._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    with pytest.raises(ValueError):
        membership(table, ["gibbs"], [0.1], [1])


@pytest.mark.parametrize("method", ["metropolis_hastings", "gibbs", "dag"])
def test_a_replayed_chain_equals_single_runs(table, method):
    from plumbline.plans.replay import LABEL, replay
    found = replay(table, [0.3, 0.05], [42, 7], method, batch_size=100)
    assert len(found.conditions) == 4 and found.n_chains <= 4
    for k, _, budget, seed, size in found.conditions:
        alone = draw_sample(method, table, budget, seed, batch_size=100)
        held = found.rows.where(F.col(LABEL) == k).select(*table.key_cols)
        assert size == held.count() == alone.n_sampled
        assert held.exceptAll(alone.df.select(*table.key_cols)).isEmpty()
    with pytest.raises(ValueError):
        replay(table, [0.1], [1], "cluster")


def test_a_replay_knows_budgets_that_would_end_their_list_of_steps(spark):
    """From row 100 on a goal of 200 lists ten steps of ten rows; twenty steps of five rows are more, five of twenty are not."""
    from plumbline.plans.replay import _listed_too_few
    state = chains.ChainState(0, 0)
    for step, budgets in ((5, [0.2, 0.3]), (20, [])):
        decisions = spark.range(100, 400, step).withColumnRenamed("id", "entry")
        walk = chains.Walk(decisions, 1000, 400, state, [(100, 50, decisions)])
        assert _listed_too_few(walk, [0.05, 0.2, 0.3], 40) == budgets


def test_chunks_of_every_batch_size_are_sums_of_leaves(table):
    from plumbline.operators.chunk_tree import plant
    from plumbline.operators.score import CellRules
    batches = [40, 80, 120]
    tree = plant(table, batches, 42, chains.Proposals(), CellRules.of(table))
    assert (tree.unit, tree.forced_unit, tree.n) == (40, 10, table.rows)
    for b in batches:
        placed = tree.rows.withColumn("chunk", tree.chunk(b))
        direct = placed.groupBy("stream", "chunk").agg(F.count(F.lit(1)).alias("size"), F.sum("defects").alias("defects"))
        merged = tree.leaves.groupBy("stream", tree.chunk(b).alias("chunk")).agg(F.sum("size").alias("size"), F.sum("defects").alias("defects"))
        assert direct.exceptAll(merged).isEmpty() and merged.exceptAll(direct).isEmpty()
        assert {r["stream"]: r["n"] for r in placed.groupBy("stream").agg((F.max("chunk") + 1).alias("n")).collect()}.items() <= tree.n_chunks(b).items()
        assert tree.rows.where(tree.starts[b].keeps(F.col("start"), list(table.key_cols))).count() == b


def test_a_batch_sweep_reaches_the_budget_for_every_batch_size(table):
    """Half of the table is more than one pass over the pool gives, so chains go on after the tree."""
    from plumbline.plans.replay import LABEL, batch_sweep
    found = batch_sweep(table, [120, 80], 0.5, [42], "metropolis_hastings")
    assert [(c[4], c[5]) for c in found.conditions] == [(table.rows // 2, 80), (table.rows // 2, 120)]
    keys = found.rows.select(LABEL, *table.key_cols)
    assert keys.count() == keys.distinct().count() == 2 * (table.rows // 2)
    with pytest.raises(ValueError):
        batch_sweep(table, [], 0.1, [1])


def test_small_cluster_tables(spark):
    df = spark.range(12).selectExpr("id", "cast(id as double) v")
    for seed in range(5):
        sample = draw_sample("cluster", audit(df, ["id"]), 0.1, seed)
        assert sample.df.count() == sample.n_sampled == 1


def test_neyman_never_exceeds_a_stratum():
    scores = {0: strata.ScoreCounts(((0.0, 1), (1.0, 1))), 1: strata.ScoreCounts(((0.0, 100),)), 2: strata.ScoreCounts(())}
    plan = strata.neyman(scores, 50, 3)
    assert [s.allocated for s in plan] == [2, 0, 0]
    assert sum(s.allocated for s in strata.neyman({1: strata.ScoreCounts(((0.5, 40),))}, 10, 3)) <= 40


def test_uniform_estimate_is_unbiased(spark):
    """Over 200 seeds the mean missing rate lies within four standard errors of the truth."""
    df = spark.range(2000).selectExpr("id", "case when id % 20 = 0 then null else 1.0D end as v")
    seeds = spark.range(200).selectExpr("id as seed")
    drawn = df.crossJoin(seeds).withColumn("u", Draws(F.col("seed")).uniform("row", "id")).where("u < 0.1")
    means = drawn.groupBy("seed").agg(F.avg(F.col("v").isNull().cast("int")).alias("m")).agg(F.avg("m"), F.stddev("m")).first()
    assert abs(means[0] - 0.05) < 4 * means[1] / math.sqrt(200)


def test_importance_prefers_high_scores(table):
    sample = draw_sample("importance", table, 0.1)
    assert sample.df.agg(F.avg("score")).first()[0] > 0.2


def test_uniform_beats_guided_where_defects_are_categorical(spark):
    """Proxies that see only numbers misjudge tables, even where rows are weighted back."""
    df = spark.range(6000).selectExpr("id", "cast(id % 97 as double) a", "case when id % 100 = 0 then 1e6 else cast(id % 89 as double) end b",
                                      "case when id % 5 = 0 then null else cast(id as string) end c")
    t = audit(df, ["id"], ["a", "b", "c"])
    truth = profile_table(t).first()["outlier_rate"]

    def gap(method, **parameters):
        return abs(draw_sample(method, t, 0.1, **parameters).profile().first()["outlier_rate"] - truth)

    assert gap("random_uniform") < gap("metropolis_hastings", batch_size=100)


def test_injected_rates(spark):
    df = spark.range(20000).selectExpr("id", "cast(id as double) a", "cast(id as double) b")
    dirty = inject.inject_missing(df, 0.05, ["id"], ["a", "b"], mode="bernoulli")
    rate = dirty.agg(F.avg(F.col("a").isNull().cast("int"))).first()[0]
    assert abs(rate - 0.05) < 4 * math.sqrt(0.05 * 0.95 / 20000)
    copied = inject.inject_duplicates(df, 0.02, ["id"])
    assert copied.count() == 20400 and copied.where("copy_no > 0").count() == 400
