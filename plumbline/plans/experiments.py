"""Condition runs and the analyses over them: accuracy, budget curves, robustness, scaling and ablations."""
from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dependency import constant_weights, pairwise_weights
from ..operators.profile import INDICATORS, profile, profile_table, relative_error
from ..operators.samplers import Sample
from ..operators.score import CellRules, clip_sweep_weights, score_counts
from ..operators.storage import materialise
from ..operators.table import AuditTable, with_ordinal
from ..sources import generate
from .membership import CHAIN_FREE, membership
from .overlay import sweep, sweep_results
from .progressive import nested_profiles
from .registry import CHAINS, GUIDED, PREFIX_SIZES, draw_sample
from .replay import batch_sweep, replay
from .results import append_results, as_budget, condition_grid, read_results, remaining

CLIPS = (None, 0.80, 0.90, 0.95, 0.99)


def _as_result(p: DataFrame, dataset: str) -> DataFrame:
    named = p.withColumnsRenamed({i: f"est_{i}" for i in INDICATORS} | {"sample_size": "n_sampled", "n_records": "n_total"})
    return named.withColumn("dataset", F.lit(dataset))


def prefix_results(t: AuditTable, methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], truth: DataFrame) -> DataFrame:
    """All conditions of the methods that take a prefix of the draw order, from one scan of the table."""
    def sizes(n: int):
        return [(m, float(b), PREFIX_SIZES[m](n, b)) for m in methods for b in budgets]

    p, n = nested_profiles(t, sizes, "method string, budget double", seeds)
    p = p.select("method", "budget", "seed", *INDICATORS, "sample_size")
    return _as_result(relative_error(p.withColumn("n_records", F.lit(n).cast("bigint")), truth), t.name)


def membership_results(t: AuditTable, methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], truth: DataFrame, **options) -> DataFrame:
    """All conditions of methods without a chain, from one tagging scan of the table."""
    return _as_result(relative_error(membership(t, methods, budgets, seeds, **options).profile().drop("sample_size"), truth), t.name)


def sampler_comparison(t: AuditTable, methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], truth: DataFrame,
                       batch_size: int = 500, **options) -> DataFrame:
    """Errors of any methods side by side: those without a chain share one scan, chains run one condition after the other."""
    parts, free = [], [m for m in methods if m in CHAIN_FREE]
    if free:
        parts.append(membership_results(t, free, budgets, seeds, truth, **options))
    edges = materialise(pairwise_weights(t), "edges") if set(methods) & set(GUIDED) else None
    for m in methods:
        if m in CHAINS:
            more = {"edges": edges} if m in GUIDED else {}
            parts += [run_condition(t, m, b, s, truth, batch_size=batch_size, **more) for b in budgets for s in seeds]
    return _together(parts)


def run_condition(t: AuditTable, method: str, budget: float, seed: int, truth: DataFrame, **parameters) -> DataFrame:
    """One result row: estimate, errors, sizes and wall time.

    ``time_search_s`` is the draw of the sample, ``time_eval_s`` the profile of it.
    """
    begin = time.perf_counter()
    if method == "exhaustive":
        sample = Sample(t, t.rows, t.rows, method, kept=True)
        budget = 1.0
    else:
        sample = draw_sample(method, t, budget, seed, **parameters).stored()
    drawn = time.perf_counter()
    estimate = materialise(relative_error(sample.profile(), truth), "result")
    done = time.perf_counter()
    row = _as_result(estimate, t.name)
    return row.withColumns({
        "method": F.lit(method), "budget": F.lit(float(budget)), "seed": F.lit(int(seed)),
        "converged": F.lit(method == "exhaustive"),
        "n_steps": F.lit(sample.n_steps), "acceptance_rate": F.lit(float(sample.acceptance_rate)),
        "time_total_s": F.lit(done - begin), "time_search_s": F.lit(drawn - begin), "time_eval_s": F.lit(done - drawn),
        "time_condition_s": F.lit(done - begin)})


def run_grid(tables: Mapping[str, AuditTable], methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int],
             path: str, truths: Mapping[str, DataFrame] | None = None, batch_size: int = 500) -> DataFrame:
    """Run every condition that has no result at ``path`` yet, appending one row each, and return all results.

    Truth and dependency weights are computed once per table.  A run that died is resumed by calling it again.
    """
    spark = next(iter(tables.values())).df.sparkSession
    grid = condition_grid(spark, dataset=list(tables), method=list(methods), budget=list(budgets), seed=list(seeds))
    # a full scan has one budget, so it is one condition per seed and is found again on resume
    full = F.when(F.col("method") == "exhaustive", as_budget(F.lit(1.0))).otherwise(F.col("budget"))
    grid = grid.withColumn("budget", full).distinct()
    done = read_results(spark, path)
    todo = grid if done is None else remaining(grid, done)
    shared: dict[str, tuple] = {}
    for c in todo.orderBy("dataset", "budget", "method", "seed").toLocalIterator():  # a list of runs, not data
        key = c["dataset"]
        t = replace(tables[key], name=key)  # the grid, its results and the shared tables all go by the name given here
        if key not in shared:
            truth = (truths or {}).get(key)
            truth = materialise(profile_table(t), "truth") if truth is None else truth
            edges = materialise(pairwise_weights(t), "edges") if set(methods) & set(GUIDED) else None
            shared[key] = (truth, edges)
        truth, edges = shared[key]
        parameters: dict = {"batch_size": batch_size} if c["method"] in CHAINS else {}
        if c["method"] in GUIDED:
            parameters["edges"] = edges
        append_results(run_condition(t, c["method"], float(c["budget"]), c["seed"], truth, **parameters), path)
    return read_results(spark, path)


# ---- analyses ------------------------------------------------------------------------------------------------------

def accuracy(tables: Mapping[str, AuditTable], methods, budgets, seeds, path: str) -> DataFrame:
    """Mean error per dataset, method and budget."""
    results = run_grid(tables, methods, budgets, seeds, path)
    return results.groupBy("dataset", "method", "budget").agg(F.avg("rel_err_mean").alias("rel_err_mean"))


def budget_accuracy(t: AuditTable, methods, budgets, seeds, path: str) -> DataFrame:
    """Error and speed-up over the full scan per condition."""
    results = run_grid({t.name: t}, [*methods, "exhaustive"], budgets, seeds, path)
    full = results.where("method = 'exhaustive'").groupBy("dataset").agg(F.avg("time_total_s").alias("t_exhaustive_s"))
    joined = results.join(F.broadcast(full), "dataset")
    return joined.withColumn("speedup", F.col("t_exhaustive_s") / F.greatest("time_total_s", F.lit(1e-6)))


def correlation_ablation(keys: DataFrame, key_cols, levels: Sequence[float], budget: float, seeds, methods=("dag", "metropolis_hastings", "gibbs")) -> DataFrame:
    """Errors on equicorrelated tables; the guided method runs with the true weights and with none."""
    parts = []
    for rho in levels:
        rates = generate.ErrorRates(correlation=rho)
        t = generate.dirty_numeric_table(keys, key_cols, rates=rates, name=f"rho_{rho}")
        t = t.with_rows(materialise(t.df, t.name))
        truth = materialise(profile_table(t), "truth")
        for seed in seeds:
            for method in methods:
                variants = {"injected": rho, "zero": 0.0} if method in GUIDED else {"none": None}
                for variant, weight in variants.items():
                    parameters = {} if weight is None else {"edges": constant_weights(t, weight)}
                    row = run_condition(t, method, budget, seed, truth, **parameters)
                    parts.append(row.withColumns({"correlation_rho": F.lit(rho), "dataset_variant": F.lit(variant)}))
    return _together(parts)


def robustness(t: AuditTable, kinds: Sequence[str], rates: Sequence[float], methods: Sequence[str], budgets: Sequence[float],
               seeds: Sequence[int], others: float = 0.01, damage_seed: int = 42) -> DataFrame:
    """Errors with one kind of damage of a given table at a rate and the other kinds at ``others``.

    All damage is one overlay of the table.  Methods that take a prefix of the draw order share its aggregates; any other
    method runs on each variant by itself.
    """
    prefix = [m for m in methods if m in PREFIX_SIZES]
    o, found = sweep_results(t, kinds, rates, prefix, budgets, seeds, others, damage_seed)
    keys = ["error_type", "error_rate", "method", "budget", "seed"]
    truth = found.select(*keys, *[F.col(f"true_{i}").alias(i) for i in INDICATORS])
    errors = relative_error(found.drop(*[f"true_{i}" for i in INDICATORS]), truth, keys)
    parts = [_as_result(errors, t.name)] if prefix else []
    for kind, rate, mixed in sweep(kinds, rates, others) if len(prefix) < len(methods) else ():
        one = o.damaged(mixed, t.name)
        one = one.with_rows(materialise(one.df, f"{kind}_{rate}"), one.known_rows)
        whole = materialise(profile_table(one), "truth")
        tags = {"error_type": F.lit(kind), "error_rate": F.lit(float(rate))}
        parts += [run_condition(one, m, b, s, whole).withColumns(tags) for m in methods if m not in PREFIX_SIZES for b in budgets for s in seeds]
    return _together(parts)


def scaling(tables: Mapping[int, AuditTable], methods, budget: float, seeds) -> DataFrame:
    """Time and error by table size."""
    parts = []
    for size, t in tables.items():
        truth = materialise(profile_table(t), "truth")
        parts += [run_condition(t, m, budget, s, truth).withColumn("n_scale", F.lit(size)) for m in methods for s in seeds]
    return _together(parts)


def weighting_ablation(tables: Mapping[str, AuditTable], budgets, seeds, path: str) -> DataFrame:
    """Guided proposals with and without inverse-score weights, against uniform rows."""
    return run_grid(tables, ["dag", "dag_uniform", "random_uniform"], budgets, seeds, path)


def batch_sizes(t: AuditTable, sizes: Sequence[int], methods, budget: float, seeds, truth: DataFrame | None = None, **options) -> DataFrame:
    """Errors of chain samplers by batch size, from one chunk tree per method and seed."""
    truth = materialise(profile_table(t), "truth") if truth is None else truth
    edges = materialise(pairwise_weights(t), "edges") if set(methods) & set(GUIDED) else None
    parts = []
    for m in methods:
        p = batch_sweep(t, sizes, budget, seeds, m, edges=edges, **options).profile().drop("clip_percentile")
        parts.append(_as_result(relative_error(p, truth), t.name))
    return _together(parts)


def clip_sweep(sample: Sample, truth: DataFrame, clips: Sequence[float | None] = CLIPS) -> DataFrame:
    """Error per clip level of the inverse-score weights, all levels on one sample in one pass."""
    t = sample.table
    rules = CellRules.of(t)
    counts = score_counts(t.df, rules)[None]
    weighted = t.df.select(*t.measured, F.inline(clip_sweep_weights(rules.score(), counts, clips)))
    p = profile(weighted, t.measured, t.rules, weight="w", group=["clip_percentile"], rows=sample.n_sampled * len(clips))
    return relative_error(p, truth)


def replayed_results(t: AuditTable, methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], truth: DataFrame,
                     clips: Sequence[float | None] = (0.95,), **options) -> DataFrame:
    """All conditions of chains, from one chain per method and seed whose log is cut at every budget."""
    edges = materialise(pairwise_weights(t), "edges") if set(methods) & set(GUIDED) else None
    parts = []
    for m in methods:
        p = replay(t, budgets, seeds, m, edges=edges, **options).profile(clips)
        parts.append(_as_result(relative_error(p, truth), t.name))
    return _together(parts)


def budget_curve(t: AuditTable, methods: Sequence[str], budgets: Sequence[float], seeds: Sequence[int], truth: DataFrame, **options) -> DataFrame:
    """Errors by method, budget and seed: chains by replay, methods without a chain by one tagging scan."""
    parts, free, walked = [], [m for m in methods if m in CHAIN_FREE], [m for m in methods if m in CHAINS]
    if free:
        parts.append(membership_results(t, free, budgets, seeds, truth))
    if walked:
        parts.append(replayed_results(t, walked, budgets, seeds, truth, **options).drop("clip_percentile"))
    return _together(parts)


def clip_ablation(t: AuditTable, budgets, seeds, truth: DataFrame, clips=CLIPS, method: str = "dag", **options) -> DataFrame:
    """Clip sweep on chain samples over budgets and seeds: one chain per seed, one grouped profile of all conditions."""
    return replayed_results(t, [method], budgets, seeds, truth, clips, **options)


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole


def compared_budgets(results: DataFrame, budget: float) -> DataFrame:
    """Results of one budget, compared as decimals."""
    return results.where(as_budget(F.col("budget")) == as_budget(F.lit(budget)))


def blocks(t: AuditTable, order_cols: Sequence[str], block: int) -> DataFrame:
    """Rows with their global position and block of consecutive rows."""
    df, _ = with_ordinal(t, order_cols)
    return df.withColumn("block", F.floor(F.col("ordinal") / block).cast("bigint"))
