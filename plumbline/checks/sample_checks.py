"""Samplers without a chain: selected keys, weighted and plain profiles, strata."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import samplers
from ..operators.profile import INDICATORS
from ..operators.strata import allocation_table, defect_type_stratum, stratify
from ..operators.table import audit
from .base import (DIRTY_CTE, DIRTY_KEY, LINE_RULES, MEASURED, NUMBERS, SCORED_CTE, Check, d, dirty_lines, expo,
                   fence_sql, load, profile_sql, rounded, u)

B, SEED = 0.1, 42
KEYS = ", ".join(DIRTY_KEY)


def _keys(method, **options):
    def run(spark, folder):
        return getattr(samplers, method)(dirty_lines(spark, folder), B, SEED, **options).df.select(*DIRTY_KEY)
    return run


def _profile(method, **options):
    def run(spark, folder):
        sample = getattr(samplers, method)(dirty_lines(spark, folder), B, SEED, **options)
        return rounded(sample.profile()).select(*INDICATORS, "sample_size", "n_records")
    return run


def sample_fixed_size(spark, folder):
    t = audit(load(spark, folder, "events"), ["event_id"])
    return samplers.fixed_size(t, 500, SEED).df.select("event_id")


def sample_increment(spark, folder):
    """Rows that a budget of 20 % adds to one of 10 %: the pool minus the sample, without a join."""
    t = dirty_lines(spark, folder)
    small, large = samplers.random_uniform(t, B, SEED), samplers.random_uniform(t, 2 * B, SEED)
    return large.df.select(*DIRTY_KEY).join(small.df.select(*DIRTY_KEY), DIRTY_KEY, "left_anti")


def sample_cluster(spark, folder):
    return samplers.cluster(dirty_lines(spark, folder), B, SEED, order_cols=["l_orderkey"], rows_per_range=8000).df.select(*DIRTY_KEY)


def profile_cluster(spark, folder):
    sample = samplers.cluster(dirty_lines(spark, folder), B, SEED, order_cols=["l_orderkey"], rows_per_range=8000)
    return rounded(sample.profile()).select(*INDICATORS, "sample_size", "n_records")


def importance_weights(spark, folder):
    sample = samplers.importance(dirty_lines(spark, folder), B, SEED)
    return sample.df.select(*DIRTY_KEY, F.round(F.col("w") * sample.n_sampled, 6).alias("relative_weight"))


def strata_of_rows(spark, folder):
    """Rows per stratum under both stratifications."""
    t = dirty_lines(spark, folder)
    by_score, _, _ = stratify(t, "quality", 3)
    return t.df.groupBy(defect_type_stratum(t).alias("by_defect"), by_score.alias("by_score")).agg(F.count(F.lit(1)).alias("n_rows"))


def _allocation(by):
    def run(spark, folder):
        return rounded(allocation_table(dirty_lines(spark, folder), B, by), ["deviation"])
    return run


def profile_strat_design(spark, folder):
    """Stratified sample with a floor per stratum and design weights N_h / n_h."""
    sample = samplers.stratified(dirty_lines(spark, folder), B, SEED, by="column", weights="design", min_per_stratum=1000)
    return rounded(sample.profile()).select(*INDICATORS, "sample_size", "n_records")


# ---- SQL -----------------------------------------------------------------------------------------------------------

ROW = u(SEED, "row", *DIRTY_KEY)
N = "(SELECT count(*) FROM dirty_lines)"
SHARE = f"CAST(floor({N} * {d(B)}) AS BIGINT)"
UNIFORM_N = f"greatest(1, {SHARE})"
GEOMETRIC_N = f"least({SHARE}, {N} - bit_count({N}))"
YAMANE_N = f"least({N}, greatest(1, CAST(floor({N} / (1 + {N} * (0.05::DOUBLE * 0.05::DOUBLE))) AS BIGINT)))"


def first_rows(size: str, src: str = "dirty_lines", draw: str = ROW) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {draw}, {KEYS}) AS rn FROM {src}) r WHERE rn <= {size}"


def _sampled(size):
    return f"WITH {DIRTY_CTE}, picked AS ({first_rows(size)}) "


def of_sample(with_clause: str, weight=None, src="picked", digits=6):
    return with_clause + (f"SELECT p.*, CAST({N} AS BIGINT) AS n_records FROM ("
                          + profile_sql(src, MEASURED, NUMBERS, LINE_RULES, weight=weight, digits=digits) + ") p")


EXPO = f"({expo(SEED, 'row', *DIRTY_KEY)} / (score + 1e-6::DOUBLE))"
IMPORTANCE = (f"WITH {DIRTY_CTE}, {SCORED_CTE}, drawn AS ({first_rows(f'greatest(1, {SHARE})', 'scored', EXPO)}), "
              "cap AS (SELECT quantile_cont(1.0 / (score + 1e-6::DOUBLE), 0.95) AS cap FROM drawn), "
              "picked AS (SELECT drawn.*, least(1.0 / (score + 1e-6::DOUBLE), cap) / sum(least(1.0 / (score + 1e-6::DOUBLE), cap)) OVER () AS w FROM drawn CROSS JOIN cap) ")
K = f"greatest(10, CAST(ceil(sqrt({N})) AS BIGINT))"
CLUSTER = (
    f"WITH {DIRTY_CTE}, numbered AS (SELECT *, row_number() OVER (ORDER BY {KEYS}) - 1 AS ordinal FROM dirty_lines), "
    f"blocks AS (SELECT block FROM (SELECT block, row_number() OVER (ORDER BY {u(SEED, 'block', 'block')}, block) AS rn FROM range({K}) t(block)) b "
    f"WHERE rn <= greatest(1, least(CAST(ceil({d(B)} * {K}) AS BIGINT), {K}))), "
    f"inside AS (SELECT n.* FROM numbered n JOIN blocks ON block = n.ordinal // CAST(ceil({N} / {K}::DOUBLE) AS BIGINT)), "
    f"picked AS ({first_rows(UNIFORM_N, 'inside')}) ")

_bad_number = " OR ".join([f"coalesce(s.{c} < x.low_{i} OR s.{c} > x.high_{i}, FALSE) OR s.{c} IS NULL" for i, c in enumerate(NUMBERS)])
_bad_label = " OR ".join(f"s.{c} IS NULL" for c in MEASURED[4:])
STRATA = {
    "column": f"tukey AS ({fence_sql('dirty_lines', NUMBERS, 'tukey')}), stratified AS (SELECT s.*, CASE WHEN {_bad_number} THEN 0 WHEN {_bad_label} THEN 1 ELSE 2 END AS stratum FROM scored s CROSS JOIN tukey x), ",
    "quality": "cuts AS (SELECT quantile_cont(score, 1.0/3.0) AS t1, quantile_cont(score, 2.0/3.0) AS t2 FROM scored), "
               "stratified AS (SELECT scored.*, CASE WHEN score >= t2 THEN 2 WHEN score >= t1 THEN 1 ELSE 0 END AS stratum FROM scored CROSS JOIN cuts), ",
}


def allocation_sql(by: str, floor: int = 0) -> str:
    return (f"{DIRTY_CTE}, {SCORED_CTE}, {STRATA[by]}"
            "sizes AS (SELECT k.stratum, count(score) AS nh, CASE WHEN count(score) > 1 THEN stddev_pop(score) ELSE 0.0 END AS sh "
            "FROM (SELECT unnest([0, 1, 2]) AS stratum) k LEFT JOIN stratified s ON s.stratum = k.stratum GROUP BY k.stratum), "
            "weighted AS (SELECT *, CASE WHEN sum(nh * sh) OVER () = 0 THEN nh ELSE nh * sh END AS wh FROM sizes), "
            f"floored AS (SELECT *, CAST(floor({UNIFORM_N} * wh / sum(wh) OVER ()) AS BIGINT) AS base, row_number() OVER (ORDER BY nh DESC, stratum) AS place FROM weighted), "
            f"allocation AS (SELECT stratum, nh, sh, least(greatest(base + CASE WHEN place <= {UNIFORM_N} - sum(base) OVER () THEN 1 ELSE 0 END, {floor}), nh) AS take FROM floored)")


def stratified_sql(by: str, floor: int = 0) -> str:
    return (f"WITH {allocation_sql(by, floor)}, picked AS (SELECT r.*, nh / take::DOUBLE AS w FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {ROW}, {KEYS}) AS rn "
            "FROM stratified) r JOIN allocation a ON a.stratum = r.stratum WHERE rn <= take) ")


def _show(by):
    return f"WITH {allocation_sql(by)} SELECT CAST(stratum AS INTEGER) AS stratum, CAST(nh AS BIGINT) AS n_rows, round(sh, 6) AS deviation, CAST(take AS BIGINT) AS allocated FROM allocation"


PICK = f"SELECT {KEYS} FROM picked"
_strata_both = (f"WITH {DIRTY_CTE}, {SCORED_CTE}, {STRATA['quality'].replace('stratified AS', 'by_score AS')}"
                f"{STRATA['column'].rstrip(', ').replace('stratified AS', 'by_defect AS')} "
                f"SELECT d.stratum AS by_defect, q.stratum AS by_score, CAST(count(*) AS BIGINT) AS n_rows FROM by_defect d JOIN by_score q USING ({KEYS}) GROUP BY 1, 2")

#: WITH clause and weight of the sample of every method without a chain, at B and SEED
SAMPLES = {"random_uniform": (_sampled(UNIFORM_N), None), "geometric": (_sampled(GEOMETRIC_N), None), "yamane": (_sampled(YAMANE_N), None),
           "cluster": (CLUSTER, None), "importance": (IMPORTANCE, "w"), "stratified_column": (stratified_sql("column"), None),
           "stratified_quality": (stratified_sql("quality"), None)}


def estimates_sql(budgets, seeds) -> str:
    """SELECT of method, budget, seed and the unrounded profile of every condition."""
    parts = []
    for method, (clause, weight) in SAMPLES.items():
        for b in budgets:
            for s in seeds:
                text = of_sample(clause, weight, digits=None).replace(f"'{SEED}'", f"'{s}'").replace(d(B), d(b))
                parts.append(f"SELECT '{method}' AS method, {d(b)} AS budget, CAST({s} AS BIGINT) AS seed, x.* FROM ({text}) x")
    return " UNION ALL ".join(parts)


CHECKS = {
    "sample_uniform": Check(_keys("random_uniform"), _sampled(UNIFORM_N) + PICK),
    "sample_geometric": Check(_keys("geometric"), _sampled(GEOMETRIC_N) + PICK),
    "sample_yamane": Check(_keys("yamane"), _sampled(YAMANE_N) + PICK),
    "sample_fixed_size": Check(sample_fixed_size, f"SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY {u(SEED, 'row', 'event_id')}, event_id) AS rn FROM events) r WHERE rn <= 500"),
    "sample_increment": Check(sample_increment, _sampled(f"greatest(1, CAST(floor({N} * {d(2 * B)}) AS BIGINT))") + f"SELECT {KEYS} FROM picked WHERE rn > {UNIFORM_N}"),
    "sample_importance": Check(_keys("importance"), IMPORTANCE + PICK),
    "importance_weights": Check(importance_weights, IMPORTANCE + f"SELECT {KEYS}, round(w * count(*) OVER (), 6) AS relative_weight FROM picked"),
    "sample_cluster": Check(sample_cluster, CLUSTER + PICK),
    "sample_strat_column": Check(_keys("stratified", by="column"), stratified_sql("column") + PICK),
    "sample_strat_quality": Check(_keys("stratified", by="quality"), stratified_sql("quality") + PICK),
    "strata_of_rows": Check(strata_of_rows, _strata_both),
    "strata_allocation_column": Check(_allocation("column"), _show("column")),
    "strata_allocation_quality": Check(_allocation("quality"), _show("quality")),
    "profile_uniform": Check(_profile("random_uniform"), of_sample(_sampled(UNIFORM_N))),
    "profile_geometric": Check(_profile("geometric"), of_sample(_sampled(GEOMETRIC_N))),
    "profile_yamane": Check(_profile("yamane"), of_sample(_sampled(YAMANE_N))),
    "profile_importance": Check(_profile("importance"), of_sample(IMPORTANCE, "w")),
    "profile_cluster": Check(profile_cluster, of_sample(CLUSTER)),
    "profile_strat_column": Check(_profile("stratified", by="column"), of_sample(stratified_sql("column"))),
    "profile_strat_quality": Check(_profile("stratified", by="quality"), of_sample(stratified_sql("quality"))),
    "profile_strat_design": Check(profile_strat_design, of_sample(stratified_sql("column", 1000), "w")),
}
