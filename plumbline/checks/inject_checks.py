"""Error injectors on orders, customers and events."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import inject
from .base import Check, copies_sql, d, load, missing_sql, outlier_sql, rounded, sign, u

SEED = 42
ORDERS, CUSTOMERS = ["o_orderkey"], ["c_custkey"]
ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
CUSTOMER_COLUMNS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
# fixed values of the test data
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LEVELS = {"value": (50.0, 20.0, 15.0)}


def _orders(spark, folder):
    return load(spark, folder, "orders").select(*ORDERS, *ORDER_COLUMNS)


def _customers(spark, folder):
    return load(spark, folder, "customer").select(*CUSTOMERS, *CUSTOMER_COLUMNS)


def inject_missing(spark, folder):
    return inject.inject_missing(_orders(spark, folder), 0.05, ORDERS, ORDER_COLUMNS, SEED, mode="bernoulli")


def inject_missing_hits(spark, folder):
    return inject.inject_missing(_orders(spark, folder), 0.05, ORDERS, ["o_custkey", "o_totalprice"], SEED)


def inject_duplicates(spark, folder):
    return inject.inject_duplicates(_customers(spark, folder), 0.05, CUSTOMERS, SEED)


def inject_many_duplicates(spark, folder):
    """More copies than rows: some rows are drawn several times."""
    return inject.inject_duplicates(_customers(spark, folder), 1.2, CUSTOMERS, SEED).groupBy(*CUSTOMERS).agg(F.count(F.lit(1)).alias("n"))


def inject_hundreds_of_copies(spark, folder):
    """Every supplier is drawn about three hundred times."""
    suppliers = load(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    return inject.inject_duplicates(suppliers, 300, ["s_suppkey"], SEED).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


def inject_duplicates_clean(spark, folder):
    """Copies of clean rows appended to a table with missing cells."""
    clean = _customers(spark, folder)
    dirty = inject.inject_missing(clean, 0.1, CUSTOMERS, CUSTOMER_COLUMNS, SEED, mode="bernoulli")
    return inject.inject_duplicates(dirty, 0.05, CUSTOMERS, SEED, source=clean)


def inject_outliers(spark, folder):
    df = inject.inject_outliers(load(spark, folder, "orders").select(*ORDERS, "o_totalprice"), 0.05, ORDERS, ["o_totalprice"], SEED)
    return rounded(df, ["o_totalprice"], 3)


def replace_with_outliers(spark, folder):
    df = inject.replace_with_outliers(load(spark, folder, "orders").select(*ORDERS, "o_totalprice"), 0.05, ORDERS, ["o_totalprice"], SEED)
    return rounded(df, ["o_totalprice"], 3)


def inject_levels(spark, folder):
    return inject.inject_levels(load(spark, folder, "events").select("event_id", "value"), 0.05, ["event_id"], LEVELS, SEED)


def inject_fd_noise(spark, folder):
    df = inject.inject_fd_noise(_orders(spark, folder).select(*ORDERS, "o_totalprice"), 0.05, ORDERS, "o_totalprice", SEED)
    return rounded(df, ["o_totalprice"], 6)


def inject_fd_per_key(spark, folder):
    df = _orders(spark, folder).select(*ORDERS, "o_custkey", "o_orderpriority")
    return inject.inject_fd_per_key(df, 0.05, ORDERS, "o_custkey", "o_orderpriority", PRIORITIES, SEED)


def fd_per_key_sql(src: str, keys, det: str, dep: str, labels, rate: float, others=(), seed: int = SEED) -> str:
    """A wrong label in one row of each chosen determinant."""
    listed = ", ".join(f"'{x}'" for x in labels)
    key_list = ", ".join(keys)
    wrong = f"list_filter([{listed}], lambda x: x IS DISTINCT FROM {dep})"
    return (f"SELECT {', '.join([*keys, *others, det])}, CASE WHEN chosen AND place = 1 THEN {wrong}[1 + CAST(floor({u(seed, 'label', *keys)} * len({wrong})) AS BIGINT)] ELSE {dep} END AS {dep} "
            f"FROM (SELECT s.*, k.{det} IS NOT NULL AS chosen, row_number() OVER (PARTITION BY s.{det} ORDER BY {u(seed, 'pick', *[f's.{k}' for k in keys])}, {', '.join(f's.{k}' for k in keys)}) AS place "
            f"FROM {src} s LEFT JOIN (SELECT {det} FROM (SELECT {det}, row_number() OVER (ORDER BY {u(seed, f'key:{det}', det)}, {det}) AS rn, count(*) OVER () AS total "
            f"FROM (SELECT DISTINCT {det} FROM {src} WHERE {det} IS NOT NULL) q) r WHERE rn <= greatest(1, CAST(floor(total * {d(rate)}) AS BIGINT))) k ON k.{det} = s.{det}) t")


_price = "(SELECT o_orderkey, o_totalprice FROM orders)"
_share_one = d(-math.expm1(-0.05))
_stats = "(SELECT count(*) AS n, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders)"
_replace = (f"SELECT o_orderkey, round(CASE WHEN {u(SEED, 'outlier:o_totalprice', 'o_orderkey')} < 1.0 - exp(-greatest(1.0, floor(n * 0.025::DOUBLE)) / n) "
            f"THEN mean + {sign(SEED, 'sign:o_totalprice', 'o_orderkey')} * 10.0 * (sd + 1e-6) ELSE o_totalprice END, 3) AS o_totalprice FROM orders CROSS JOIN {_stats} x")
_copies = copies_sql("customer", "customer", CUSTOMERS, CUSTOMER_COLUMNS, 0.05, SEED)
_many = copies_sql("customer", "customer", CUSTOMERS, CUSTOMER_COLUMNS, 1.2, SEED, depth=14)

CHECKS = {
    "inject_missing": Check(inject_missing, missing_sql("orders", ORDERS, ORDER_COLUMNS, 0.05, SEED)),
    "inject_missing_hits": Check(inject_missing_hits, missing_sql("orders", ORDERS, ["o_custkey", "o_totalprice"], -math.expm1(-0.05), SEED, ["o_orderstatus", "o_orderpriority"])),
    "inject_duplicates": Check(inject_duplicates, _copies),
    "inject_hundreds_of_copies": Check(inject_hundreds_of_copies, f"""
WITH gaps AS (SELECT s_suppkey, j, -ln(CAST('0x' || substr(md5(concat_ws('|', '{SEED}', 'copy' || j, CAST(s_suppkey AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE
              + 1.1102230246251565e-16::DOUBLE) AS gap FROM supplier CROSS JOIN range(1, 600) r(j)),
arrivals AS (SELECT s_suppkey, j, sum(gap) OVER (PARTITION BY s_suppkey ORDER BY j) AS arrival FROM gaps),
numbered AS (SELECT s_suppkey, row_number() OVER (ORDER BY arrival, s_suppkey, j) AS rn FROM arrivals)
SELECT s_suppkey, 1 + count(*) FILTER (rn <= 300 * (SELECT count(*) FROM supplier)) AS n FROM numbered GROUP BY s_suppkey"""),
    "inject_many_duplicates": Check(inject_many_duplicates, f"SELECT c_custkey, CAST(count(*) AS BIGINT) AS n FROM ({_many}) t GROUP BY c_custkey"),
    "inject_duplicates_clean": Check(inject_duplicates_clean, f"WITH holes AS ({missing_sql('customer', CUSTOMERS, CUSTOMER_COLUMNS, 0.1, SEED)}) "
                                     + copies_sql("holes", "customer", CUSTOMERS, CUSTOMER_COLUMNS, 0.05, SEED)),
    "inject_outliers": Check(inject_outliers, "SELECT o_orderkey, round(o_totalprice, 3) AS o_totalprice FROM ("
                             + outlier_sql(_price, ORDERS, ["o_totalprice"], [], 0.05, SEED, "orders").replace("o_orderkey AS VARCHAR", "s.o_orderkey AS VARCHAR") + ") t"),
    "replace_with_outliers": Check(replace_with_outliers, _replace),
    "inject_levels": Check(inject_levels, f"SELECT event_id, CASE WHEN {u(SEED, 'level:value', 'event_id')} < {_share_one} THEN 50.0 + {sign(SEED, 'sign:value', 'event_id')} * 300.0 ELSE value END AS value FROM events"),
    "inject_fd_noise": Check(inject_fd_noise, f"SELECT o_orderkey, round(CASE WHEN {u(SEED, 'break:o_totalprice', 'o_orderkey')} < {_share_one} "
                             f"THEN -100.0 + 200.0 * {u(SEED, 'noise:o_totalprice', 'o_orderkey')} ELSE o_totalprice END, 6) AS o_totalprice FROM orders"),
    "inject_fd_per_key": Check(inject_fd_per_key, fd_per_key_sql("orders", ORDERS, "o_custkey", "o_orderpriority", PRIORITIES, 0.05)),
}
