"""The results table: one row per finished condition, appended batch by batch, merged, resumed and reported.

Stored results are a log of versions (``sources.versions``): whatever step a writer dies at, readers see the results before or after.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import INDICATORS
from ..sources import versions

# fixed values: the columns of the results table
CONDITION = ("dataset", "method", "budget", "seed")
MANY_FOLDERS = 64  # appends beyond this many data folders compact them
ERRORS = tuple(f"rel_err_{i}" for i in INDICATORS) + ("rel_err_mean", "rel_err_abs_mean")


# ---- grids ---------------------------------------------------------------------------------------------------------

def as_budget(column):
    """Budgets are compared as decimals, never as text of a float."""
    return column.cast("decimal(9,6)")


def condition_grid(spark: SparkSession, axes: Mapping[str, Sequence] | None = None, **more: Sequence) -> DataFrame:
    """Every combination of the listed values, one column per axis (budgets as DECIMAL)."""
    grid = None
    for name, values in {**(axes or {}), **more}.items():
        axis = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
        if name == "budget":
            axis = axis.withColumn(name, as_budget(F.col(name)))
        grid = axis if grid is None else grid.crossJoin(F.broadcast(axis))
    return grid


def remaining(grid: DataFrame, results: DataFrame, on: Sequence[str] = CONDITION) -> DataFrame:
    """Conditions of the grid that have no result yet."""
    on = [c for c in on if c in grid.columns]
    done = results.select(*[(as_budget(F.col(c)) if c == "budget" else F.col(c)).alias(c) for c in on]).distinct()
    return grid.join(done, on, "left_anti")


# ---- storage -------------------------------------------------------------------------------------------------------

def write_results(rows: DataFrame, path: str) -> None:
    """Store ``rows`` in place of whatever is there."""
    folder = versions.write_folder(rows, path, "dataset")
    versions.change(rows.sparkSession, path, lambda _: [folder])


def append_results(rows: DataFrame, path: str) -> None:
    """Add finished conditions; a failed write leaves the earlier ones untouched, and appends at one time lose nothing."""
    spark, folder = rows.sparkSession, versions.write_folder(rows, path, "dataset")
    versions.change(spark, path, lambda folders: [*folders, folder])
    if len(versions.latest(spark, path)[1]) > MANY_FOLDERS:
        compact_results(spark, path)


def compact_results(spark: SparkSession, path: str) -> None:
    """Bring the data folders of the newest version together in one."""
    def merged(folders: list[str]) -> list[str]:
        return folders if len(folders) < 2 else [versions.write_folder(versions.read_folders(spark, path, folders), path, "dataset")]

    versions.change(spark, path, merged)


def read_results(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The results so far, or None before the first append."""
    _, folders = versions.latest(spark, path)
    return versions.read_folders(spark, path, folders, schema) if folders else None


def append_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def replace_merge(old: DataFrame, new: DataFrame, method: str) -> DataFrame:
    """Drop the earlier rows of one method and add the new ones; running it twice changes nothing."""
    return old.where(~F.col("method").eqNullSafe(F.lit(method))).unionByName(new, allowMissingColumns=True)


def replace_results(rows: DataFrame, path: str, method: str) -> None:
    """Replace the rows of one method in the stored results: the merged table is a new version, the old one stays as it is."""
    spark = rows.sparkSession

    def merged(folders: list[str]) -> list[str]:
        found = rows if not folders else replace_merge(versions.read_folders(spark, path, folders), rows, method)
        return [versions.write_folder(found, path, "dataset")]

    versions.change(spark, path, merged)


# ---- reports -------------------------------------------------------------------------------------------------------

def report_row(df: DataFrame) -> DataFrame:
    """Half-even rounding: times to 3 digits, rates to 4, estimates and errors to 6."""
    digits = {c: 3 for c in ("time_total_s", "time_search_s", "time_eval_s", "time_condition_s")}
    digits |= {"acceptance_rate": 4} | {f"est_{i}": 6 for i in INDICATORS} | {e: 6 for e in ERRORS}
    return df.withColumns({c: F.bround(F.col(c), d) for c, d in digits.items() if c in df.columns})


def summary(results: DataFrame, by: Sequence[str], value: str = "rel_err_mean", how: str = "avg") -> DataFrame:
    """Mean or sum of a measure per group."""
    return results.groupBy(*by).agg({"avg": F.avg, "sum": F.sum}[how](value).alias(value))


def pivoted(results: DataFrame, row: str, column: str, values: Sequence, value: str = "rel_err_mean") -> DataFrame:
    """Mean of a measure as a table of ``row`` by ``column``; the column values are given, so no extra job lists them."""
    return results.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def ordered_summary(results: DataFrame, label: str, order: Sequence[str], value: str = "rel_err_mean") -> DataFrame:
    """Mean per label in a fixed order; labels without rows stay, with NULL."""
    spark = results.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in order])).alias("position", label))
    means = results.groupBy(label).agg(F.avg(value).alias(value))
    return listed.join(F.broadcast(means), label, "left").select("position", label, value)


def slowest(results: DataFrame, time: str = "time_condition_s") -> DataFrame:
    """The condition that took longest, and the mean time over all of them."""
    others = [c for c in results.columns if c != time]
    return results.agg(F.max_by(F.struct(*others), F.col(time)).alias("c"), F.max(time).alias(f"max_{time}"),
                       F.avg(time).alias(f"mean_{time}")).select("c.*", f"max_{time}", f"mean_{time}")
