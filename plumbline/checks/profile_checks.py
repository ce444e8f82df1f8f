"""Profile indicators, flags, keys and quantiles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quantiles
from ..operators.profile import (INDICATORS, mark_duplicates, profile, profile_long, profile_table, relative_error, row_flags)
from ..operators.score import error_proxy
from ..operators.table import audit, with_ordinal
from .base import (DIRTY_CTE, DIRTY_KEY, LINE_RULES, MEASURED, NUMBERS, SCORED_CTE, Check, dirty_lines, flag_sql, load,
                   profile_sql, rounded)

TEXT = ["text", "lang", "source", "n_chars"]


def _documents(spark, folder, rules=None, columns=TEXT):
    return audit(load(spark, folder, "documents").select("doc_id", *columns), ["doc_id"], columns, rules, "documents")


def _rates(t, *wanted, **options):
    return rounded(profile_table(t, indicators=wanted, **options), wanted).select(*wanted, "sample_size")


def _pick(sql, *wanted):
    return f"SELECT {', '.join(wanted)}, sample_size FROM ({sql}) p"


def missing_rate(spark, folder):
    return _rates(dirty_lines(spark, folder), "missing_rate")


def _weighted(spark, folder):
    t = dirty_lines(spark, folder)
    return t.with_rows(t.df.withColumn("w", F.col("l_linenumber").cast("double")))


def missing_rate_weighted(spark, folder):
    return _rates(_weighted(spark, folder), "missing_rate", weight="w")


def quality_profile_weighted(spark, folder):
    return _rates(_weighted(spark, folder), *INDICATORS, weight="w")


def duplicate_rate(spark, folder):
    return _rates(_documents(spark, folder, columns=["text", "lang"]), "duplicate_rate")


def duplicate_flags(spark, folder):
    return mark_duplicates(load(spark, folder, "documents").select("doc_id", "text", "lang"), ["text", "lang"]).select("doc_id", "is_duplicate")


def outlier_rate(spark, folder):
    return _rates(audit(load(spark, folder, "events").select("event_id", "value"), ["event_id"], ["value"]), "outlier_rate")


def outlier_flags(spark, folder):
    t = audit(load(spark, folder, "documents").select("doc_id", "n_chars"), ["doc_id"], ["n_chars"])
    return row_flags(t).select("doc_id", "is_outlier")


def outlier_zfallback(spark, folder):
    spiky = load(spark, folder, "lineitem").select(*DIRTY_KEY[:4], F.when(F.col("l_orderkey") % 500 == 0, 100.0).otherwise(1.0).alias("v"))
    return _rates(audit(spiky, DIRTY_KEY[:4], ["v"]), "outlier_rate")


def fd_violation_rate(spark, folder):
    return _rates(_documents(spark, folder, {"text": "source"}), "inconsistency_rate")


MANY = [("text", "source"), ("source", "lang"), ("text", "lang")]


def fd_violation_multi(spark, folder):
    return _rates(_documents(spark, folder, [("text", "source"), (("lang", "n_chars"), "source")]), "inconsistency_rate")


def fd_violation_hot_key(spark, folder):
    """A determinant with a handful of values: each holds a large share of the rows."""
    t = dirty_lines(spark, folder, [("l_returnflag", "l_linestatus"), ("l_quantity", "l_tax")])
    return _rates(t, "inconsistency_rate")


def quality_profile(spark, folder):
    return _rates(_documents(spark, folder, MANY), *INDICATORS)


def quality_profile_dirty(spark, folder):
    return _rates(dirty_lines(spark, folder), *INDICATORS)


def quality_profile_exact_rows(spark, folder):
    """Duplicates grouped by the columns themselves instead of their hash."""
    return _rates(dirty_lines(spark, folder), *INDICATORS, exact_rows=True)


def profile_in_long_form(spark, folder):
    return profile_long(quality_profile_dirty(spark, folder)).select("indicator", "value", "sample_size")


def profile_per_group(spark, folder):
    t = dirty_lines(spark, folder)
    rest = [c for c in MEASURED if c != "l_linestatus"]
    return rounded(profile(t.df, rest, LINE_RULES, group=["l_linestatus"]))


def relative_error_of_rows(spark, folder):
    """Line items of one status against all of them."""
    t = dirty_lines(spark, folder)
    part = profile(t.df.where("l_linestatus = 'F'"), MEASURED, LINE_RULES)
    errors = [f"rel_err_{i}" for i in INDICATORS] + ["rel_err_mean", "rel_err_abs_mean"]
    return rounded(relative_error(part, profile_table(t)), errors).select(*errors)


def flags_of_rows(spark, folder):
    return row_flags(dirty_lines(spark, folder))


def error_proxy_scores(spark, folder):
    return rounded(error_proxy(dirty_lines(spark, folder)), ["score"])


def row_copies(spark, folder):
    """Row identity of a keyless table."""
    return audit(load(spark, folder, "events").select("event_type", "user_id")).df.select("event_type", "user_id", "row_copy")


def global_ordinal(spark, folder):
    t = audit(load(spark, folder, "events").select("event_id", "ts", "value"), ["event_id"])
    return with_ordinal(t, ["ts"], rows_per_range=1000)[0].select("event_id", "ordinal")


PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def quantiles_by_refinement(spark, folder):
    """Order statistics by repeated histograms."""
    q = quantiles.quantile_table(load(spark, folder, "lineitem").select("l_returnflag", *NUMBERS), NUMBERS, PROBS, ["l_returnflag"])
    points = [F.struct(F.lit(c).alias("name"), F.lit(p).alias("p"), F.round(F.get(c, F.lit(i)), 6).alias("value"))
              for c in NUMBERS for i, p in enumerate(PROBS)]
    return q.select("l_returnflag", F.inline(F.array(*points)))


def quantiles_of_many_groups(spark, folder):
    """Quartiles of the line items of every part: thousands of groups, none of which comes to the driver."""
    q = quantiles.quantile_table(load(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], (0.25, 0.5, 0.75), ["l_partkey"])
    return q.select("l_partkey", *[F.round(F.get(c, F.lit(i)), 6).alias(f"{name}_{p}") for c, name in (("l_quantity", "quantity"), ("l_extendedprice", "price"))
                                   for i, p in enumerate((25, 50, 75))])


DOC_NUM = ["n_chars"]
D = f"WITH {DIRTY_CTE} "
_two = [("text", "source"), (("lang", "n_chars"), "source")]
_dirty_profile = profile_sql("dirty_lines", MEASURED, NUMBERS, LINE_RULES)
_weight_profile = profile_sql("(SELECT *, CAST(l_linenumber AS DOUBLE) AS w FROM dirty_lines)", MEASURED, NUMBERS, LINE_RULES, weight="w")
_errors = {i: f"least(abs(e.{i} - t.{i}) / greatest(t.{i}, 0.05), 1.0)" for i in INDICATORS}
_gaps = [f"abs(e.{i} - t.{i})" for i in INDICATORS]
_exact = profile_sql("dirty_lines", MEASURED, NUMBERS, LINE_RULES, digits=None)
_part = profile_sql("(SELECT * FROM dirty_lines WHERE l_linestatus = 'F')", MEASURED, NUMBERS, LINE_RULES, digits=None)
_rest = [c for c in MEASURED if c != "l_linestatus"]
_spiky = f"(SELECT {', '.join(DIRTY_KEY[:4])}, CASE WHEN l_orderkey % 500 = 0 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM lineitem)"

CHECKS = {
    "missing_rate": Check(missing_rate, D + _pick(_dirty_profile, "missing_rate")),
    "missing_rate_weighted": Check(missing_rate_weighted, D + _pick(_weight_profile, "missing_rate")),
    "duplicate_rate": Check(duplicate_rate, _pick(profile_sql("documents", ["text", "lang"], []), "duplicate_rate")),
    "duplicate_flags": Check(duplicate_flags, "SELECT doc_id, count(*) OVER (PARTITION BY text, lang) > 1 AS is_duplicate FROM documents"),
    "outlier_rate": Check(outlier_rate, _pick(profile_sql("events", ["value"], ["value"]), "outlier_rate")),
    "outlier_flags": Check(outlier_flags, f"SELECT doc_id, is_outlier FROM ({flag_sql('documents', ['n_chars'], ['n_chars'])}) t"),
    "outlier_zfallback": Check(outlier_zfallback, _pick(profile_sql(_spiky, ["v"], ["v"]), "outlier_rate")),
    "fd_violation_rate": Check(fd_violation_rate, _pick(profile_sql("documents", TEXT, DOC_NUM, [("text", "source")]), "inconsistency_rate")),
    "fd_violation_multi": Check(fd_violation_multi, _pick(profile_sql("documents", TEXT, DOC_NUM, _two), "inconsistency_rate")),
    "fd_violation_hot_key": Check(fd_violation_hot_key, D + _pick(profile_sql(
        "dirty_lines", MEASURED, NUMBERS, [("l_returnflag", "l_linestatus"), ("l_quantity", "l_tax")]), "inconsistency_rate")),
    "quality_profile": Check(quality_profile, profile_sql("documents", TEXT, DOC_NUM, MANY)),
    "quality_profile_dirty": Check(quality_profile_dirty, D + _dirty_profile),
    "quality_profile_exact_rows": Check(quality_profile_exact_rows, D + _dirty_profile),
    "quality_profile_weighted": Check(quality_profile_weighted, D + _weight_profile),
    "profile_long": Check(profile_in_long_form, f"WITH {DIRTY_CTE}, p AS ({_dirty_profile}) " + " UNION ALL ".join(
        f"SELECT '{i}' AS indicator, {i} AS value, sample_size FROM p" for i in INDICATORS)),
    "profile_per_group": Check(profile_per_group, D + profile_sql(
        "dirty_lines", _rest, NUMBERS, LINE_RULES, ["l_linestatus"])),
    "relative_error": Check(relative_error_of_rows, D + "SELECT " + ", ".join(
        [f"round({e}, 6) AS rel_err_{i}" for i, e in _errors.items()]
        + [f"round(({' + '.join(_errors.values())}) / 4, 6) AS rel_err_mean", f"round(({' + '.join(_gaps)}) / 4, 6) AS rel_err_abs_mean"])
        + f" FROM ({_part}) e CROSS JOIN ({_exact}) t"),
    "row_flags": Check(flags_of_rows, D + f"SELECT {', '.join(DIRTY_KEY)}, null_cells, is_duplicate, is_outlier, is_inconsistent FROM ("
                       + flag_sql("dirty_lines", MEASURED, NUMBERS, LINE_RULES) + ") t"),
    "error_proxy": Check(error_proxy_scores, f"WITH {DIRTY_CTE}, {SCORED_CTE} SELECT {', '.join(DIRTY_KEY)}, round(score, 6) AS score FROM scored"),
    "row_copies": Check(row_copies, "SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type, user_id) AS row_copy FROM events"),
    "global_ordinal": Check(global_ordinal, "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events"),
    "quantiles_by_refinement": Check(quantiles_by_refinement, " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS name, {p}::DOUBLE AS p, round(quantile_cont({c}, {p}), 6) AS value FROM lineitem GROUP BY l_returnflag"
        for c in NUMBERS for p in PROBS)),
    "quantiles_of_many_groups": Check(quantiles_of_many_groups, "SELECT l_partkey, " + ", ".join(
        f"round(quantile_cont({c}, {p / 100}), 6) AS {name}_{p}" for c, name in (("l_quantity", "quantity"), ("l_extendedprice", "price")) for p in (25, 50, 75))
        + " FROM lineitem GROUP BY l_partkey"),
}
