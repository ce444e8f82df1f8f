"""Confidence intervals and the Raftery-Lewis diagnostic over tables of estimates."""
from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_table

# fixed values: normal quantiles per confidence level
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}
SHORT_CHAIN = 20


def wald_interval(estimates: DataFrame, value: str = "value", size: str = "sample_size", confidence: float = 0.95) -> DataFrame:
    """Add lower, upper, margin and width of ``p +- z sqrt(p(1-p)/max(n,1))``, clipped to [0, 1]."""
    if confidence not in Z:
        raise ValueError(f"confidence must be one of {sorted(Z)}")
    p, n = F.col(value), F.greatest(F.col(size), F.lit(1))
    margin = F.lit(Z[confidence]) * F.sqrt(p * (1 - p) / n)
    lower, upper = F.greatest(F.lit(0.0), p - margin), F.least(F.lit(1.0), p + margin)
    return estimates.withColumns({"margin": margin, "lower": lower, "upper": upper, "width": upper - lower})


def transitions(chain: DataFrame, q: float = 0.025, rows: int | None = None) -> DataFrame:
    """Two-state transition counts per indicator of ``chain(indicator, step, value)``, steps being consecutive integers.

    A step meets its successor in an equi join on (indicator, step), so a long chain is not gathered in one task.
    """
    at = quantile_table(chain, ["value"], [q], ["indicator"], rows).select("indicator", F.get("value", F.lit(0)).alias("threshold"))
    states = chain.join(F.broadcast(at), "indicator").select("indicator", "step", (F.col("value") <= F.col("threshold")).cast("int").alias("state"))
    after = states.select("indicator", (F.col("step") - 1).alias("step"), F.col("state").alias("next"))
    moves = states.join(after, ["indicator", "step"], "left")
    counts = [F.count_if((F.col("state") == a) & (F.col("next") == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)]
    return moves.groupBy("indicator").agg(F.count(F.lit(1)).alias("n_current"), *counts)


def raftery_lewis(chain: DataFrame, q: float = 0.025, r: float = 0.005, s: float = 0.95, rows: int | None = None) -> DataFrame:
    """Chain length needed to estimate the q-quantile within r with probability s, per indicator.

    Columns: n_current, n_required, burn_in, dependence_factor, converged, message.  ``burn_in`` is NULL where its
    formula divides by zero (a chain that never returns to the low state).
    """
    z = NormalDist().inv_cdf((1 + s) / 2)
    c = transitions(chain, q, rows)
    leave = F.col("n01") / F.greatest(F.col("n00") + F.col("n01"), F.lit(1))
    back = F.col("n10") / F.greatest(F.col("n10") + F.col("n11"), F.lit(1))
    c = c.withColumns({"a": leave, "b": back}).withColumn("ab", F.col("a") + F.col("b"))
    c = c.withColumn("p", F.col("b") / F.nullif("ab", F.lit(0.0)))
    need = (2 * F.col("a") * F.col("b") * (1 - F.col("ab")) * z**2) / F.greatest(F.pow("ab", F.lit(3)) * r**2, F.lit(1e-12))
    c = c.withColumn("need", need)
    pq = F.col("p") * (1 - F.col("p"))
    c = c.withColumn("factor", F.col("need") * pq / F.greatest(pq, F.lit(1e-9)))
    required = F.greatest((F.col("factor") * F.col("need")).cast("bigint"), F.lit(SHORT_CHAIN).cast("bigint"))
    decay = F.ln(F.abs(1 - F.col("ab")) + 1e-9)
    steps = F.ln(F.lit(r) / F.nullif("p", F.lit(0.0))) / F.nullif(decay, F.lit(0.0))
    burn = F.when(steps.isNotNull(), F.greatest(steps.cast("bigint"), F.lit(0).cast("bigint")))  # greatest() skips NULL
    short, constant = F.col("n_current") < SHORT_CHAIN, F.col("ab") == 0
    result = c.withColumns({
        "n_required": F.when(short, F.lit(100)).when(constant, F.col("n_current")).otherwise(required).cast("bigint"),
        "burn_in": F.when(short | constant, F.lit(0).cast("bigint")).otherwise(burn),
        "dependence_factor": F.when(short, 0.0).when(constant, 1.0).otherwise(F.col("factor")),
    })
    result = result.withColumn("converged", ~short & (constant | (F.col("n_current") >= F.col("n_required"))))
    message = (
        F.when(short, "chain too short").when(constant, "constant chain").when(F.col("converged"), "ok")
        .otherwise(F.format_string("%d more steps needed", F.col("n_required") - F.col("n_current")))
    )
    return result.select("indicator", "n_current", "n_required", "burn_in", "dependence_factor", "converged", message.alias("message"))


def all_converged(diagnosis: DataFrame) -> DataFrame:
    """One row: true if every chain of at least 20 steps has converged and there is one."""
    long_enough = F.col("n_current") >= SHORT_CHAIN
    checked = F.count_if(long_enough)
    good = F.count_if(long_enough & F.col("converged"))
    return diagnosis.agg(((checked > 0) & (checked == good)).alias("all_converged"), checked.alias("n_checked"))
