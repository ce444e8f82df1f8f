"""Progressive curves, clip sweep, condition grids, results and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import samplers
from ..operators.profile import INDICATORS, profile_table
from ..operators.storage import shared_folder
from ..plans import experiments, progressive, results
from ..sources.cache import parameter_key
from .base import (DIRTY_CTE, DIRTY_KEY, LINE_RULES, MEASURED, NUMBERS, Check, d, dirty_lines, load, profile_sql, rounded, u)
from .chain_checks import BATCH, batch_sweep_sql, single_runs_sql
from .dependency_checks import VERDICT, verdict_sql
from .sample_checks import IMPORTANCE, SAMPLES, estimates_sql

BUDGETS, SEEDS = (0.01, 0.02, 0.05, 0.1, 0.2), (42, 7)
ERRORS = [f"rel_err_{i}" for i in INDICATORS] + ["rel_err_mean", "rel_err_abs_mean"]
MEASURES = [*INDICATORS, *ERRORS]


def progressive_curve(spark, folder):
    t = dirty_lines(spark, folder)
    return rounded(progressive.progressive_curve(t, BUDGETS, SEEDS, profile_table(t)), MEASURES)


def curve_intervals(spark, folder):
    curve = progressive.progressive_curve(dirty_lines(spark, folder), BUDGETS, SEEDS)
    wide = progressive.curve_intervals(curve)
    return rounded(wide, ["value", "margin", "lower", "upper", "width"])


def settled_budget(spark, folder):
    """Smallest budget per seed whose intervals are all at most 2.5 % wide."""
    return progressive.first_settled_budget(progressive.progressive_curve(dirty_lines(spark, folder), BUDGETS, SEEDS), 0.025)


MANY_BUDGETS = tuple(round(0.01 * k, 2) for k in range(1, 25))


def curve_converged(spark, folder):
    """The chain of estimates along 24 nested samples."""
    return progressive.converged(progressive.progressive_curve(dirty_lines(spark, folder), MANY_BUDGETS))


def clip_sweep(spark, folder):
    t = dirty_lines(spark, folder)
    sample = samplers.importance(t, 0.1, 42)
    swept = experiments.clip_sweep(sample, profile_table(t))
    return rounded(swept, MEASURES).select("clip_percentile", *MEASURES)


METHODS = ("random_uniform", "geometric", "yamane")


def _conditions(spark, folder):
    t = dirty_lines(spark, folder)
    return experiments.prefix_results(t, METHODS, (0.05, 0.1), SEEDS, profile_table(t))


def accuracy_conditions(spark, folder):
    """Every (method, budget, seed) of the methods that take a prefix of the draw order, from one scan."""
    named = [f"est_{i}" for i in INDICATORS] + ERRORS
    return rounded(_conditions(spark, folder), named).select("dataset", "method", "budget", "seed", "n_sampled", "n_total", *named)


def accuracy_summary(spark, folder):
    return rounded(results.summary(_conditions(spark, folder), ["dataset", "method", "budget"]), ["rel_err_mean"], 5)


def sampler_comparison(spark, folder):
    """Every method without a chain at two budgets and two seeds: one tagging scan, one grouped profile."""
    t = dirty_lines(spark, folder)
    found = experiments.sampler_comparison(t, list(SAMPLES), (0.05, 0.1), SEEDS, profile_table(t, apart=True), order_cols=["l_orderkey"], rows_per_range=100_000)
    named = [f"est_{i}" for i in INDICATORS]
    return rounded(found, [*named, *ERRORS]).select("dataset", "method", "budget", "seed", "n_sampled", "n_total", *named, *ERRORS)


GUIDED_BUDGETS = (0.03, 0.06, 0.1)


def clip_ablation(spark, folder):
    """Five clip levels on guided samples of three budgets, all from the decisions of one chain."""
    t = dirty_lines(spark, folder)
    found = experiments.clip_ablation(t, GUIDED_BUDGETS, [42], profile_table(t), batch_size=BATCH)
    named = [f"est_{i}" for i in INDICATORS]
    return rounded(found, [*named, *ERRORS]).select("dataset", "method", "budget", "seed", "clip_percentile", "n_sampled", "n_total", *named, *ERRORS)


def budget_curve(spark, folder):
    """Errors by budget of two chains, each replayed from one run, beside uniform rows (wall times left out)."""
    t = dirty_lines(spark, folder)
    found = experiments.budget_curve(t, ["metropolis_hastings", "dag", "random_uniform"], GUIDED_BUDGETS, [42], profile_table(t, apart=True), batch_size=BATCH)
    named = [f"est_{i}" for i in INDICATORS]
    return rounded(found, [*named, *ERRORS]).select("dataset", "method", "budget", "seed", "n_sampled", "n_total", *named, *ERRORS)


BATCHES = (100, 200, 400, 1000)


def batch_size_sweep(spark, folder):
    """Errors of two chains at four batch sizes, from one count of leaves per chain."""
    t = dirty_lines(spark, folder)
    found = experiments.batch_sizes(t, BATCHES, ["metropolis_hastings", "dag"], 0.1, [42], profile_table(t))
    named = [f"est_{i}" for i in INDICATORS]
    return rounded(found, [*named, *ERRORS]).select("dataset", "method", "budget", "seed", "batch_size", "n_sampled", "n_total", *named, *ERRORS)


def guided_against_uniform(spark, folder):
    """Wall times differ per run, so only the estimates of the condition runs are kept."""
    t = dirty_lines(spark, folder)
    path = f"{shared_folder(spark)}/grid-{parameter_key(folder=folder, app=spark.sparkContext.applicationId)}"
    found = experiments.run_grid({t.name: t}, ["dag", "random_uniform"], [0.1], [42], path)
    return rounded(found, ERRORS, 5).select("dataset", "method", "budget", "seed", "n_sampled", *ERRORS)


# ---- reports over a results table derived from the line items --------------------------------------------------------

RESULTS_SQL = ("SELECT l_returnflag AS dataset, l_linestatus AS method, l_discount AS budget, CAST(l_linenumber AS BIGINT) AS seed, "
               "avg(l_tax) AS rel_err_mean, sum(l_quantity) AS time_condition_s FROM lineitem GROUP BY 1, 2, 3, 4")


def _results(spark, folder, table="lineitem"):
    return load(spark, folder, table).groupBy(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"), F.col("l_discount").alias("budget"),
        F.col("l_linenumber").cast("bigint").alias("seed"),
    ).agg(F.avg("l_tax").alias("rel_err_mean"), F.sum("l_quantity").alias("time_condition_s"))


def condition_grid(spark, folder):
    """Datasets found in the data, crossed with methods, budgets and seeds."""
    datasets = load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("dataset")).distinct()
    rest = results.condition_grid(spark, method=["F", "O", "X"], budget=[0.01, 0.05], seed=[1, 2, 9])
    grid = datasets.crossJoin(F.broadcast(rest))
    return grid.withColumns({"budget": F.col("budget").cast("double"), "seed": F.col("seed").cast("bigint")})


def resume_grid(spark, folder):
    """Conditions without a result."""
    datasets = load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("dataset")).distinct()
    rest = results.condition_grid(spark, method=["F", "O", "X"], budget=[0.01, 0.05], seed=[1, 2, 9])
    left = results.remaining(datasets.crossJoin(F.broadcast(rest)), _results(spark, folder))
    return left.select("dataset", "method", F.col("budget").cast("double").alias("budget"), F.col("seed").cast("bigint").alias("seed"))


def results_summary(spark, folder):
    return rounded(results.summary(_results(spark, folder), ["dataset", "method"]), ["rel_err_mean"])


def results_total_time(spark, folder):
    return rounded(results.summary(_results(spark, folder), ["method"], "time_condition_s", "sum"), ["time_condition_s"], 3)


def results_pivot(spark, folder):
    one = experiments.compared_budgets(_results(spark, folder), 0.05)
    return rounded(results.pivoted(one, "dataset", "method", ["F", "O"]), ["F", "O"])


def ordered_summary(spark, folder):
    """Mean per seed in a fixed order; seeds without results stay."""
    return rounded(results.ordered_summary(_results(spark, folder).withColumn("label", F.col("seed").cast("string")), "label",
                                           ["none", "7", "1", "4"]), ["rel_err_mean"])


def slowest_condition(spark, folder):
    slow = results.slowest(_results(spark, folder).select("dataset", "method", "budget", "seed", "time_condition_s"))
    return rounded(slow, ["max_time_condition_s", "mean_time_condition_s"], 3)


def replace_merge(spark, folder):
    """Rows of one method replaced by new ones, twice with the same outcome."""
    old = _results(spark, folder).select("dataset", "method", "budget", "seed", "rel_err_mean")
    new = old.where("method = 'F' and seed <= 3").withColumn("rel_err_mean", F.lit(0.5))
    return rounded(results.replace_merge(results.replace_merge(old, new, "F"), new, "F"), ["rel_err_mean"])


def append_and_read_back(spark, folder):
    """Results written, appended to, and read back."""
    path = f"{shared_folder(spark)}/results-{parameter_key(folder=folder, app=spark.sparkContext.applicationId)}"
    rows = _results(spark, folder)
    results.write_results(rows.where("seed <= 3"), path)
    results.append_results(rows.where("seed > 3"), path)
    return rounded(results.read_results(spark, path), ["rel_err_mean", "time_condition_s"]).select(*rows.columns)


def replace_in_place(spark, folder):
    """Stored results of one method replaced where they lie, twice, and read back."""
    path = f"{shared_folder(spark)}/replaced-{parameter_key(folder=folder, app=spark.sparkContext.applicationId)}"
    old = _results(spark, folder).select("dataset", "method", "budget", "seed", "rel_err_mean")
    new = old.where("method = 'F' and seed <= 3").withColumn("rel_err_mean", F.lit(0.5))
    results.write_results(old, path)
    for _ in range(2):
        results.replace_results(new, path, "F")
    return rounded(results.read_results(spark, path), ["rel_err_mean"]).select(*old.columns)


def report_rows(spark, folder):
    """Half-even rounding to report digits."""
    part = load(spark, folder, "part").select("p_partkey", (F.col("p_size") / 16).alias("time_total_s"), (F.col("p_size") / 32).alias("acceptance_rate"))
    return results.report_row(part)


def append_merge(spark, folder):
    rows = _results(spark, folder).select("dataset", "method", "budget", "seed")
    return results.append_merge(rows.where("seed <= 3"), rows.where("seed > 3"))


# ---- SQL -----------------------------------------------------------------------------------------------------------

D = f"WITH {DIRTY_CTE}, "
_row = u("seed", "row", *DIRTY_KEY)
_keys = ", ".join(DIRTY_KEY)


def _listed(values, kind="DOUBLE"):
    return "unnest([" + ", ".join(f"{v}::{kind}" for v in values) + "])"


def _ranked(seeds):
    return (f"ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {_row}, {_keys}) AS rn, count(*) OVER (PARTITION BY seed) AS total "
            f"FROM dirty_lines CROSS JOIN (SELECT {_listed(seeds, 'INTEGER')} AS seed) s)")


def _curve(budgets, seeds, digits=None):
    nested = f"nested AS MATERIALIZED (SELECT r.*, budget FROM ranked r JOIN (SELECT {_listed(budgets)} AS budget) b ON rn <= greatest(1, CAST(floor(total * budget) AS BIGINT)))"
    return f"{_ranked(seeds)}, {nested}, curve AS ({profile_sql('nested', MEASURED, NUMBERS, LINE_RULES, ['seed', 'budget'], digits=digits)})"


_truth = f"truth AS ({profile_sql('dirty_lines', MEASURED, NUMBERS, LINE_RULES, digits=None)})"


def _error_columns(e="e", t="t", digits=6):
    bounded = [f"least(abs({e}.{i} - {t}.{i}) / greatest({t}.{i}, 0.05), 1.0)" for i in INDICATORS]
    gaps = [f"abs({e}.{i} - {t}.{i})" for i in INDICATORS]
    exprs = [*bounded, f"({' + '.join(bounded)}) / 4", f"({' + '.join(gaps)}) / 4"]
    return ", ".join(f"round({x}, {digits}) AS {name}" for x, name in zip(exprs, ERRORS))


_rates = ", ".join(f"round(e.{i}, 6) AS {i}" for i in INDICATORS)
_long = " UNION ALL ".join(f"SELECT seed, budget, sample_size, '{i}' AS indicator, {i} AS value FROM curve" for i in INDICATORS)
_margin = "1.96 * sqrt(value * (1 - value) / greatest(sample_size, 1))"
_low, _high = f"greatest(0.0, value - {_margin})", f"least(1.0, value + {_margin})"
_clips = {"none": None, "80": 0.8, "90": 0.9, "95": 0.95, "99": 0.99}
_levels = " UNION ALL ".join(f"SELECT '{k}' AS clip_percentile, {'max(NULL::DOUBLE)' if p is None else f'quantile_cont(1.0 / (score + 1e-6::DOUBLE), {p})'} AS level FROM drawn" for k, p in _clips.items())
_swept = f"levels AS ({_levels}), swept AS (SELECT drawn.*, clip_percentile, coalesce(least(1.0 / (score + 1e-6::DOUBLE), level), 1.0 / (score + 1e-6::DOUBLE)) / 1e6 AS w FROM drawn CROSS JOIN levels)"
_sizes = ("CASE method WHEN 'random_uniform' THEN greatest(1, CAST(floor(total * budget) AS BIGINT)) "
          "WHEN 'geometric' THEN least(CAST(floor(total * budget) AS BIGINT), total - bit_count(total)) "
          "ELSE least(total, greatest(1, CAST(floor(total / (1 + total * (0.05::DOUBLE * 0.05::DOUBLE))) AS BIGINT))) END")
_conditions_sql = (f"{_ranked(SEEDS)}, nested AS MATERIALIZED (SELECT r.*, method, budget FROM ranked r CROSS JOIN (SELECT unnest(['random_uniform', 'geometric', 'yamane']) AS method) m "
                   f"CROSS JOIN (SELECT {_listed((0.05, 0.1))} AS budget) b WHERE rn <= {_sizes}), "
                   f"curve AS ({profile_sql('nested', MEASURED, NUMBERS, LINE_RULES, ['method', 'budget', 'seed'], digits=None)}), {_truth}")
_total = "(SELECT CAST(count(*) AS BIGINT) FROM dirty_lines)"
R = f"WITH results AS ({RESULTS_SQL}) "
_grid = ("SELECT dataset, method, budget, seed FROM (SELECT DISTINCT l_returnflag AS dataset FROM lineitem) d CROSS JOIN (SELECT unnest(['F', 'O', 'X']) AS method) m "
         "CROSS JOIN (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE]) AS budget) b CROSS JOIN (SELECT unnest([1::BIGINT, 2::BIGINT, 9::BIGINT]) AS seed) s")

_replayed = ("'dirty_lines' AS dataset, method, budget, 42 AS seed, {clip}e.sample_size AS n_sampled, e.n_records AS n_total, "
             + ", ".join(f"round(e.{i}, 6) AS est_{i}" for i in INDICATORS) + f", {_error_columns()} FROM e CROSS JOIN truth t")
_chain_curve = " UNION ALL ".join(f"SELECT * EXCLUDE (clip_percentile) FROM ({single_runs_sql(m, GUIDED_BUDGETS, {'95': 0.95})}) c" for m in ("metropolis_hastings", "dag"))


def _uniform_curve(budgets):
    return f"SELECT 'random_uniform' AS method, budget, c.* EXCLUDE (budget, seed), {_total} AS n_records FROM (WITH {_curve(budgets, (42,))} SELECT * FROM curve) c"


_two = f"SELECT * EXCLUDE (clip_percentile) FROM ({single_runs_sql('dag', (0.1,), {'95': 0.95})}) c UNION ALL BY NAME {_uniform_curve((0.1,))}"

CHECKS = {
    "progressive_curve": Check(progressive_curve, f"{D}{_curve(BUDGETS, SEEDS)}, {_truth} SELECT e.seed, e.budget, {_rates}, e.sample_size, {_total} AS n_records, {_error_columns()} FROM curve e CROSS JOIN truth t"),
    "curve_intervals": Check(curve_intervals, f"{D}{_curve(BUDGETS, SEEDS)}, l AS ({_long}) SELECT seed, budget, sample_size, indicator, round(value, 6) AS value, "
                             f"round({_margin}, 6) AS margin, round({_low}, 6) AS lower, round({_high}, 6) AS upper, round({_high} - {_low}, 6) AS width FROM l"),
    "settled_budget": Check(settled_budget, f"{D}{_curve(BUDGETS, SEEDS)}, l AS ({_long}), widest AS (SELECT seed, budget, max({_high} - {_low}) AS w FROM l GROUP BY 1, 2) "
                            "SELECT seed, min(budget) FILTER (WHERE w <= 0.025) AS budget FROM widest GROUP BY seed"),
    "curve_converged": Check(curve_converged, f"{D}{_curve(MANY_BUDGETS, (42,))}, chain AS (SELECT indicator, row_number() OVER (PARTITION BY indicator ORDER BY budget) AS step, value FROM ({_long}) l), "
                             f"{verdict_sql(0.025, 0.005)} {VERDICT}"),
    "clip_sweep": Check(clip_sweep, IMPORTANCE.rstrip() + f", {_swept}, {_truth}, est AS ({profile_sql('swept', MEASURED, NUMBERS, LINE_RULES, ['clip_percentile'], weight='w', digits=None)}) "
                        f"SELECT clip_percentile, {_rates}, {_error_columns()} FROM est e CROSS JOIN truth t"),
    "accuracy_conditions": Check(accuracy_conditions, f"{D}{_conditions_sql} SELECT 'dirty_lines' AS dataset, method, budget, seed, e.sample_size AS n_sampled, {_total} AS n_total, "
                                 + ", ".join(f"round(e.{i}, 6) AS est_{i}" for i in INDICATORS) + f", {_error_columns()} FROM curve e CROSS JOIN truth t"),
    "accuracy_summary": Check(accuracy_summary, f"{D}{_conditions_sql} SELECT 'dirty_lines' AS dataset, method, budget, round(avg(rel_err_mean), 5) AS rel_err_mean FROM "
                              f"(SELECT method, budget, {_error_columns(digits=15)} FROM curve e CROSS JOIN truth t) x GROUP BY 2, 3"),
    "sampler_comparison": Check(sampler_comparison, f"{D}{_truth}, e AS ({estimates_sql((0.05, 0.1), SEEDS)}) SELECT 'dirty_lines' AS dataset, method, budget, seed, e.sample_size AS n_sampled, e.n_records AS n_total, "
                                + ", ".join(f"round(e.{i}, 6) AS est_{i}" for i in INDICATORS) + f", {_error_columns()} FROM e CROSS JOIN truth t"),
    "clip_ablation": Check(clip_ablation, f"{D}{_truth}, e AS ({single_runs_sql('dag', GUIDED_BUDGETS, _clips)}) SELECT {_replayed.format(clip='clip_percentile, ')}"),
    "budget_curve": Check(budget_curve, f"{D}{_truth}, e AS ({_chain_curve} UNION ALL BY NAME {_uniform_curve(GUIDED_BUDGETS)}) SELECT {_replayed.format(clip='')}"),
    "batch_size_sweep": Check(batch_size_sweep, f"{D}{_truth}, e AS (SELECT *, 0.1::DOUBLE AS budget FROM ({batch_sweep_sql('metropolis_hastings', BATCHES)} UNION ALL {batch_sweep_sql('dag', BATCHES)}) q) "
                              f"SELECT {_replayed.format(clip='batch_size, ')}"),
    "guided_against_uniform": Check(guided_against_uniform, f"{D}{_truth}, e AS ({_two}) SELECT 'dirty_lines' AS dataset, method, budget, 42 AS seed, e.sample_size AS n_sampled, {_error_columns(digits=5)} FROM e CROSS JOIN truth t"),
    "condition_grid": Check(condition_grid, _grid),
    "resume_grid": Check(resume_grid, R + f"SELECT g.* FROM ({_grid}) g WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.dataset = g.dataset AND r.method = g.method AND r.seed = g.seed AND round(r.budget, 6) = round(g.budget, 6))"),
    "results_summary": Check(results_summary, R + "SELECT dataset, method, round(avg(rel_err_mean), 6) AS rel_err_mean FROM results GROUP BY 1, 2"),
    "results_total_time": Check(results_total_time, R + "SELECT method, round(sum(time_condition_s), 3) AS time_condition_s FROM results GROUP BY 1"),
    "results_pivot": Check(results_pivot, R + "SELECT dataset, round(avg(rel_err_mean) FILTER (WHERE method = 'F'), 6) AS \"F\", round(avg(rel_err_mean) FILTER (WHERE method = 'O'), 6) AS \"O\" FROM results WHERE round(budget, 6) = 0.05 GROUP BY 1"),
    "ordered_summary": Check(ordered_summary, R + "SELECT CAST(position - 1 AS INTEGER) AS position, label, round(avg(rel_err_mean), 6) AS rel_err_mean FROM (SELECT unnest(['none', '7', '1', '4']) AS label, unnest([1, 2, 3, 4]) AS position) l "
                             "LEFT JOIN results ON CAST(seed AS VARCHAR) = label GROUP BY 1, 2"),
    "slowest_condition": Check(slowest_condition, R + "SELECT dataset, method, budget, seed, round(time_condition_s, 3) AS max_time_condition_s, round((SELECT avg(time_condition_s) FROM results), 3) AS mean_time_condition_s FROM results ORDER BY time_condition_s DESC LIMIT 1"),
    "replace_merge": Check(replace_merge, R + "SELECT dataset, method, budget, seed, round(rel_err_mean, 6) AS rel_err_mean FROM results WHERE method <> 'F' UNION ALL SELECT dataset, method, budget, seed, 0.5 FROM results WHERE method = 'F' AND seed <= 3"),
    "replace_in_place": Check(replace_in_place, R + "SELECT dataset, method, budget, seed, round(rel_err_mean, 6) AS rel_err_mean FROM results WHERE method <> 'F' UNION ALL SELECT dataset, method, budget, seed, 0.5 FROM results WHERE method = 'F' AND seed <= 3"),
    "append_merge": Check(append_merge, R + "SELECT dataset, method, budget, seed FROM results"),
    "append_and_read_back": Check(append_and_read_back, R + "SELECT dataset, method, budget, seed, round(rel_err_mean, 6) AS rel_err_mean, round(time_condition_s, 6) AS time_condition_s FROM results"),
    "report_rows": Check(report_rows, "SELECT p_partkey, round_even(p_size / 16.0::DOUBLE, 3) AS time_total_s, round_even(p_size / 32.0::DOUBLE, 4) AS acceptance_rate FROM part"),
}
