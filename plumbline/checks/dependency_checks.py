"""Dependency weights, priorities, intervals and convergence."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import convergence, dependency
from ..operators.profile import INDICATORS, profile_long, profile_table
from ..operators.table import audit
from .base import DIRTY_CTE, LINE_RULES, MEASURED, NUMBERS, Check, dirty_lines, load, profile_sql, rounded


def pairwise_weights(spark, folder):
    return rounded(dependency.pairwise_weights(dirty_lines(spark, folder)), ["weight"])


WIDTH = 64  # fixed value of the test data


def pairwise_weights_wide(spark, folder):
    """All pairs of the 64 dimensions of the vectors as columns of one wide table."""
    names = [f"d{k}" for k in range(WIDTH)]
    wide = load(spark, folder, "embeddings").select("vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(names)])
    return rounded(dependency.pairwise_weights(audit(wide, ["vec_id"], names, name="vectors")), ["weight"])


def column_priority(spark, folder):
    t = dirty_lines(spark, folder)
    return rounded(dependency.column_priority(t, dependency.pairwise_weights(t)), ["priority"])


def priority_of_constant_weights(spark, folder):
    """Known weights instead of fitted ones, as the correlation ablation uses, over fitted affinities."""
    t = dirty_lines(spark, folder)
    edges = dependency.constant_weights(t, 0.3)
    return rounded(dependency.column_priority(t, edges, dependency.error_affinity(t, _is_error())), ["priority"])


def _is_error():
    return F.col("l_discount").isNull() | (F.col("l_discount") > 0.05)


def error_affinity(spark, folder):
    return rounded(dependency.error_affinity(dirty_lines(spark, folder), _is_error()), ["affinity"])


def neighbourhood_weights(spark, folder):
    t = dirty_lines(spark, folder)
    return rounded(dependency.neighbourhood_weights(t, dependency.pairwise_weights(t), "l_quantity"), ["weight"])


def wald_intervals(spark, folder):
    long = profile_long(profile_table(dirty_lines(spark, folder)).select(*INDICATORS, "sample_size"))
    return rounded(convergence.wald_interval(long), ["value", "margin", "lower", "upper", "width"])


def _chain(spark, folder):
    """Mean event value per fifty events and type, a constant chain, and one that is too short."""
    events = load(spark, folder, "events").select(F.col("event_type").alias("indicator"), F.floor(F.col("event_id") / 50).cast("bigint").alias("step"), "value")
    means = events.groupBy("indicator", "step").agg(F.avg("value").alias("value"))
    steps = events.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    constant = steps.select(F.lit("constant").alias("indicator"), "step", F.lit(1.0).alias("value"))
    short = steps.where("step < 10").select(F.lit("short").alias("indicator"), "step", F.col("n").cast("double").alias("value"))
    return means.unionByName(constant).unionByName(short)


def chain_transitions(spark, folder):
    return convergence.transitions(_chain(spark, folder), q=0.1)


def raftery_lewis(spark, folder):
    return rounded(convergence.raftery_lewis(_chain(spark, folder), q=0.1, r=0.05), ["dependence_factor"], 4)


def all_converged(spark, folder):
    return convergence.all_converged(convergence.raftery_lewis(_chain(spark, folder), q=0.1, r=0.05))


# ---- SQL -----------------------------------------------------------------------------------------------------------

def _corr(a, b):
    return f"coalesce(abs(corr(coalesce({a}, 0), coalesce({b}, 0))), 0.0)"


_edges = (f"corrs AS (SELECT {', '.join(f'{_corr(a, b)} AS w_{i}_{j}' for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i < j)} FROM dirty_lines), edges AS ("
          + " UNION ALL ".join(f"SELECT '{a}' AS col_i, '{b}' AS col_j, w_{min(i, j)}_{max(i, j)} AS weight FROM corrs"
                               for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i != j) + ")")
_columns = " UNION ALL ".join(f"SELECT '{c}' AS col" for c in MEASURED)
_share = f"1.0::DOUBLE / {len(MEASURED)}"
_flag = "(l_discount IS NULL OR l_discount > 0.05)"
_affinity = ("raw AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, 1.0 + abs(avg({c}) FILTER (WHERE {_flag}) - avg({c}) FILTER (WHERE NOT {_flag})) / (stddev_samp({c}) + 1e-9) AS raw FROM dirty_lines"
    if c in NUMBERS else f"SELECT '{c}' AS col, {_share} AS raw" for c in MEASURED) + "), affinity AS (SELECT col, raw / sum(raw) OVER () AS affinity FROM raw)")


def _priority(edges: str, affinity: str) -> str:
    return (f"SELECT col, round((coalesce(degree, 0) + affinity) / sum(coalesce(degree, 0) + affinity) OVER (), 6) AS priority "
            f"FROM ({affinity}) a LEFT JOIN (SELECT col_i, sum(weight) AS degree FROM {edges} GROUP BY col_i) e ON e.col_i = a.col")


_even = f"SELECT col, {_share} AS affinity FROM ({_columns}) c"
_constant = f"(SELECT a.col AS col_i, b.col AS col_j, 0.3::DOUBLE AS weight FROM ({_columns}) a CROSS JOIN ({_columns}) b WHERE a.col <> b.col)"
_long = " UNION ALL ".join(f"SELECT '{i}' AS indicator, {i} AS value, sample_size FROM p" for i in INDICATORS)
_margin = "1.96 * sqrt(value * (1 - value) / greatest(sample_size, 1))"
_chain_sql = ("means AS (SELECT event_type AS indicator, event_id // 50 AS step, avg(value) AS value FROM events GROUP BY 1, 2), "
              "ticks AS (SELECT event_id // 50 AS step, count(*) AS n FROM events GROUP BY 1), "
              "chain AS (SELECT * FROM means UNION ALL SELECT 'constant', step, 1.0 FROM ticks UNION ALL SELECT 'short', step, n FROM ticks WHERE step < 10)")


def counts_sql(q: float) -> str:
    """Transition counts of a table ``chain(indicator, step, value)``."""
    return ("flagged AS (SELECT c.indicator, c.step, CASE WHEN c.value <= t.cut THEN 1 ELSE 0 END AS b FROM chain c JOIN (SELECT indicator, quantile_cont(value, " + str(q) + ") AS cut FROM chain GROUP BY indicator) t USING (indicator)), "
            "moves AS (SELECT a.indicator, a.b AS x, z.b AS y FROM flagged a LEFT JOIN flagged z ON z.indicator = a.indicator AND z.step = a.step + 1), "
            "counts AS (SELECT indicator, CAST(count(*) AS BIGINT) AS n_current, " + ", ".join(
                f"CAST(count(*) FILTER (WHERE x = {a} AND y = {b}) AS BIGINT) AS n{a}{b}" for a in (0, 1) for b in (0, 1)) + " FROM moves GROUP BY indicator)")


_z2 = repr(NormalDist().inv_cdf(0.975) ** 2)


def verdict_sql(q: float, r: float) -> str:
    """Raftery-Lewis diagnosis of a table ``chain``."""
    return (f"{counts_sql(q)}, rates AS (SELECT *, n01 / greatest(n00 + n01, 1)::DOUBLE AS a, n10 / greatest(n10 + n11, 1)::DOUBLE AS b FROM counts), "
            "stationary AS (SELECT *, CASE WHEN a + b > 0 THEN b / (a + b) END AS p FROM rates), "
            f"needs AS (SELECT *, 2 * a * b * (1 - (a + b)) * {_z2}::DOUBLE / greatest((a + b) * (a + b) * (a + b) * {r}::DOUBLE * {r}::DOUBLE, 1e-12) AS need FROM stationary), "
            "factors AS (SELECT *, need * (p * (1 - p)) / greatest(p * (1 - p), 1e-9) AS factor FROM needs), "
            "required AS (SELECT *, CASE WHEN n_current < 20 THEN 100 WHEN a + b = 0 THEN n_current ELSE greatest(CAST(trunc(factor * need) AS BIGINT), 20) END AS n_required, "
            f"CASE WHEN n_current < 20 OR a + b = 0 THEN 0 WHEN p > 0 THEN greatest(CAST(trunc(ln({r}::DOUBLE / p) / ln(abs(1 - a - b) + 1e-9)) AS BIGINT), 0) END AS burn_in FROM factors), "
            "verdict AS (SELECT indicator, n_current, CAST(n_required AS BIGINT) AS n_required, CAST(burn_in AS BIGINT) AS burn_in, "
            "round(CASE WHEN n_current < 20 THEN 0.0 WHEN a + b = 0 THEN 1.0 ELSE factor END, 4) AS dependence_factor, "
            "n_current >= 20 AND (a + b = 0 OR n_current >= n_required) AS converged, "
            "CASE WHEN n_current < 20 THEN 'chain too short' WHEN a + b = 0 THEN 'constant chain' WHEN n_current >= n_required THEN 'ok' "
            "ELSE CAST(n_required - n_current AS VARCHAR) || ' more steps needed' END AS message FROM required)")


VERDICT = ("SELECT count(*) FILTER (WHERE n_current >= 20) > 0 AND bool_and(converged) FILTER (WHERE n_current >= 20) AS all_converged, "
           "CAST(count(*) FILTER (WHERE n_current >= 20) AS BIGINT) AS n_checked FROM verdict")
D = f"WITH {DIRTY_CTE}, "

CHECKS = {
    "pairwise_weights": Check(pairwise_weights, f"{D}{_edges} SELECT col_i, col_j, round(weight, 6) AS weight FROM edges"),
    "pairwise_weights_wide": Check(pairwise_weights_wide, f"""
WITH cells AS MATERIALIZED (SELECT vec_id, k, coalesce(CAST(embedding[k + 1] AS DOUBLE), 0.0) AS x FROM embeddings CROSS JOIN range({WIDTH}) r(k))
SELECT 'd' || a.k AS col_i, 'd' || b.k AS col_j, round(coalesce(abs(covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0)), 0.0), 6) AS weight
FROM cells a JOIN cells b ON a.vec_id = b.vec_id AND a.k <> b.k GROUP BY 1, 2"""),
    "column_priority": Check(column_priority, f"{D}{_edges} " + _priority("edges", _even)),
    "priority_of_constant_weights": Check(priority_of_constant_weights, f"{D}{_affinity} " + _priority(_constant, "SELECT * FROM affinity")),
    "error_affinity": Check(error_affinity, f"{D}{_affinity} SELECT col, round(affinity, 6) AS affinity FROM affinity"),
    "neighbourhood_weights": Check(neighbourhood_weights, f"{D}{_edges} SELECT col, round((coalesce(weight, 0) + affinity) / sum(coalesce(weight, 0) + affinity) OVER (), 6) AS weight "
                                   f"FROM ({_even}) a LEFT JOIN (SELECT * FROM edges WHERE col_i = 'l_quantity') e ON e.col_j = a.col"),
    "wald_intervals": Check(wald_intervals, f"{D}p AS ({profile_sql('dirty_lines', MEASURED, NUMBERS, LINE_RULES, digits=None)}), l AS ({_long}) "
                            f"SELECT indicator, round(value, 6) AS value, sample_size, round({_margin}, 6) AS margin, round(greatest(0.0, value - {_margin}), 6) AS lower, "
                            f"round(least(1.0, value + {_margin}), 6) AS upper, round(least(1.0, value + {_margin}) - greatest(0.0, value - {_margin}), 6) AS width FROM l"),
    "chain_transitions": Check(chain_transitions, f"WITH {_chain_sql}, {counts_sql(0.1)} SELECT * FROM counts"),
    "raftery_lewis": Check(raftery_lewis, f"WITH {_chain_sql}, {verdict_sql(0.1, 0.05)} SELECT * FROM verdict"),
    "all_converged": Check(all_converged, f"WITH {_chain_sql}, {verdict_sql(0.1, 0.05)} {VERDICT}"),
}
