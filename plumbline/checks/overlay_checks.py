"""Many kinds and rates of damage laid over the orders at once, each variant checked on its own."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators.profile import INDICATORS
from ..operators.table import AuditTable, audit
from ..plans import experiments, overlay
from .base import Check, d, expo, load, profile_sql, rounded, sign, u
from .experiment_checks import ERRORS, _error_columns, _listed, _sizes

SEED, KEY = 42, ["o_orderkey"]
CELLS = ["o_custkey", "c_nationkey", "o_totalprice", "o_orderpriority"]
NUMERIC = CELLS[:3]
RULES = {"o_custkey": "c_nationkey"}
RATES, METHODS, BUDGETS, SEEDS = (0.05, 0.1, 0.2), ("geometric", "random_uniform"), (0.2,), (42, 7)
CONDITION = ["error_type", "error_rate", "method", "budget", "seed"]


def orders_with_nations(spark, folder) -> AuditTable:
    """Every order with the nation of its customer, so that the customer determines the nation."""
    nations = load(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    orders = load(spark, folder, "orders").select(*KEY, "o_custkey", "o_totalprice", "o_orderpriority")
    return audit(orders.join(nations, "o_custkey", "left"), KEY, CELLS, RULES, "orders")


def error_sweep(spark, folder):
    """True rates of 4 kinds x 3 rates of damage, from one pass over the table and the rows that differ."""
    t = orders_with_nations(spark, folder)
    listed = overlay.sweep(overlay.KINDS, RATES)
    o = overlay.lay_over(t, [r for *_, r in listed], SEED)
    base = overlay.one_error_type("missing", 0.01)
    found = overlay.variant_profiles(o, [(0, F.lit(True), base)], [(v, 0, r) for v, (*_, r) in enumerate(listed)])
    names = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("error_type"), F.lit(r).alias("error_rate")) for v, (k, r, _) in enumerate(listed)])
    named = found.withColumn("of", F.element_at(names, F.col("variant") + 1))
    return rounded(named.select("of.error_type", "of.error_rate", *INDICATORS, "sample_size"))


def robustness_sweep(spark, folder):
    """Errors of two methods on samples of every variant."""
    found = experiments.robustness(orders_with_nations(spark, folder), overlay.KINDS, RATES, METHODS, BUDGETS, SEEDS, damage_seed=SEED)
    named = [f"est_{i}" for i in INDICATORS]
    return rounded(found, [*named, *ERRORS]).select("dataset", *CONDITION, "n_sampled", "n_total", *named, *ERRORS)


def _variants() -> str:
    rows = []
    for kind, rate, r in overlay.sweep(overlay.KINDS, RATES):
        shares = [-math.expm1(-r.missing), r.duplicate, -math.expm1(-r.outlier / len(NUMERIC)), -math.expm1(-r.inconsistency)]
        rows.append(f"({len(rows)}, '{kind}', {d(rate)}, {', '.join(d(s) for s in shares)})")
    return f"variants(v, error_type, error_rate, missing, copied, moved, broken) AS (VALUES {', '.join(rows)})"


def _drawn() -> str:
    """Every row and copy with its draws; ``place`` is the place of a copy in the order of arrival."""
    depth = 7
    times = [" + ".join(expo(SEED, f"copy{j}", *KEY) for j in range(1, n + 1)) for n in range(1, depth + 1)]
    arrivals = " UNION ALL ".join(f"SELECT *, {n} AS copy_no, {t} AS arrival FROM clean" for n, t in enumerate(times, start=1))
    every = [*KEY, "copy_no"]
    columns = [f"{u(SEED, f'missing:{c}', *KEY)} AS missing_{c}" for c in CELLS]
    columns += [f"{u(SEED, f'outlier:{c}', *every)} AS moved_{c}" for c in NUMERIC]
    columns += [f"{sign(SEED, f'sign:{c}', *every)} * 10.0 * (sd_{c} + 1e-6) AS shift_{c}" for c in NUMERIC]
    columns += [f"{u(SEED, 'break:c_nationkey', *every)} AS breaks", f"-100.0 + 200.0 * {u(SEED, 'noise:c_nationkey', *every)} AS noise"]
    numbers = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
    sds = ", ".join(f"stddev_samp({c}) AS sd_{c}" for c in NUMERIC)
    return (f"clean AS MATERIALIZED (SELECT o_orderkey, {numbers}, o_orderpriority FROM orders LEFT JOIN customer ON c_custkey = o_custkey), "
            f"copies AS (SELECT * EXCLUDE (arrival), row_number() OVER (ORDER BY arrival, o_orderkey, copy_no) AS place FROM ({arrivals}) a), "
            f"everything AS (SELECT *, 0 AS copy_no, 0 AS place FROM clean UNION ALL SELECT * FROM copies WHERE place <= (SELECT 0.2 * count(*) FROM clean)), "
            f"drawn AS MATERIALIZED (SELECT e.*, {', '.join(columns)} FROM everything e CROSS JOIN (SELECT {sds} FROM clean) s)")


def _cell(c: str) -> str:
    cell = f"r.{c} + CASE WHEN moved_{c} < x.moved THEN shift_{c} ELSE 0.0 END" if c in NUMERIC else f"r.{c}"
    cell = f"CASE WHEN missing_{c} >= x.missing THEN {cell} END"
    return f"{cell if c != 'c_nationkey' else f'CASE WHEN breaks < x.broken THEN noise ELSE {cell} END'} AS {c}"


_rules = [("o_custkey", "c_nationkey")]
_damaged = (f"WITH {_variants()}, {_drawn()}, damaged AS MATERIALIZED (SELECT v, error_type, error_rate, o_orderkey, copy_no, {', '.join(_cell(c) for c in CELLS)} "
            "FROM drawn r CROSS JOIN variants x WHERE place <= CAST(floor((SELECT count(*) FROM clean) * copied) AS BIGINT)), "
            f"truth AS ({{truth}})")
_WHICH = ["v", "error_type", "error_rate"]


def _with(digits) -> str:
    return _damaged.format(truth=profile_sql("damaged", CELLS, NUMERIC, _rules, _WHICH, digits=digits))


_order = ", ".join([u("seed", "row", *KEY, "copy_no"), *KEY, "copy_no"])
_ranked = (f"ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY v, seed ORDER BY {_order}) AS rn, count(*) OVER (PARTITION BY v, seed) AS total "
           f"FROM damaged CROSS JOIN (SELECT {_listed(SEEDS, 'BIGINT')} AS seed) s)")
_picked = (f"picked AS MATERIALIZED (SELECT * FROM ranked CROSS JOIN (SELECT unnest({list(METHODS)}) AS method) m CROSS JOIN (SELECT {_listed(BUDGETS)} AS budget) b WHERE rn <= {_sizes})")
_estimates = profile_sql("picked", CELLS, NUMERIC, _rules, [*_WHICH, "method", "budget", "seed"], digits=None)

CHECKS = {
    "error_sweep": Check(error_sweep, f"{_with(6)} SELECT error_type, error_rate, {', '.join(INDICATORS)}, sample_size FROM truth"),
    "robustness_sweep": Check(robustness_sweep, f"{_with(None)}, {_ranked}, {_picked}, e AS ({_estimates}) SELECT 'orders' AS dataset, e.error_type, e.error_rate, method, budget, seed, "
                              "e.sample_size AS n_sampled, t.sample_size AS n_total, " + ", ".join(f"round(e.{i}, 6) AS est_{i}" for i in INDICATORS)
                              + f", {_error_columns()} FROM e JOIN truth t ON t.v = e.v"),
}
