"""Exact-size selection: the n rows with the smallest draw, as a plain filter.

``orderBy(draw).limit(n)`` either sorts the table or keeps n rows per task.  Here one or two histogram passes over
the draw find the value of the n-th smallest row; the sample is then ``draw <= cutoff``, which runs inside the scan:
no sort, no shuffle, no join, whatever n is.  Only the histogram (at most BINS rows per group) reaches the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 65536
FINE_ROWS = 50_000


@dataclass(frozen=True)
class Cutoff:
    """The n-th smallest row of a group in (draw, key) order."""

    size: int
    group: object = None
    everything: bool = False
    draw: float | None = None
    key: tuple = ()
    tied: bool = False  # another row has the same draw, so the key decides

    def keeps(self, draw: Column, key_cols: Sequence[str], group: Column | None = None) -> Column:
        """Predicate that is true for the selected rows."""
        if self.size <= 0:
            kept = F.lit(False)
        elif self.everything:
            kept = F.lit(True)
        elif not self.tied:
            kept = draw <= F.lit(self.draw)
        else:
            kept = (draw < F.lit(self.draw)) | ((draw == F.lit(self.draw)) & _not_after(key_cols, self.key))
        return kept if group is None else (group == F.lit(self.group)) & kept


def _not_after(key_cols: Sequence[str], key: tuple) -> Column:
    """Key order with nulls first, as ORDER BY sorts them."""
    predicate = F.lit(True)
    for name, value in reversed(list(zip(key_cols, key))):
        column = F.col(name)
        before = F.coalesce(column < F.lit(value), column.isNull() & F.lit(value is not None))
        predicate = before | (column.eqNullSafe(F.lit(value)) & predicate)
    return predicate


def cutoffs(
    df: DataFrame,
    draw: Column,
    key_cols: Sequence[str],
    wanted: Callable[[dict], dict],
    group: Column | None = None,
    spread: Callable[[Column], Column] | None = None,
) -> tuple[dict, dict]:
    """Find several cutoffs at once.

    ``wanted`` maps the row count per group to ``{label: (group value, size)}``.  ``spread`` is a non-decreasing map
    of the draw into [0, 1) when the draw is not uniform already.  Returns (row count per group, cutoff per label).
    """
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(key_cols)]
    rows = df.select(
        (F.lit(None).cast("string") if group is None else group).alias("g"), draw.alias("d"), *keys
    ).withColumn("s", F.col("d") if spread is None else spread(F.col("d")))

    counts = rows.groupBy("g", F.floor(F.col("s") * BINS).cast("int").alias("bin")).count().collect()
    per_group: dict = {}
    for r in counts:
        per_group.setdefault(r["g"], {})[r["bin"]] = r["count"]
    totals = {g: sum(bins.values()) for g, bins in per_group.items()}

    result: dict = {}
    open_targets: dict = {}  # label -> (group, low, width, rank inside, rows inside)
    for label, (g, n) in wanted(totals).items():
        if n <= 0 or n >= totals.get(g, 0):
            result[label] = Cutoff(min(n, totals.get(g, 0)), g, everything=True)
        else:
            at, rank, inside = _locate(per_group[g], n)
            open_targets[label] = (g, at / BINS, 1.0 / BINS, rank, inside)
            result[label] = Cutoff(n, g)

    coarse = sorted({int(low * BINS) for _, low, *_ in open_targets.values()})
    # one reference to the draw: a filter repeats the hash expression for every reference it makes
    near = rows.where(F.floor(F.col("s") * BINS).cast("int").isin(coarse)) if coarse else rows
    while any(inside > FINE_ROWS and width > 2.0**-48 for _, _, width, _, inside in open_targets.values()):
        bin_no = F.floor((F.col("s") - F.col("t.low")) / F.col("t.width") * BINS).cast("int")
        counts = _targeted(near, open_targets).groupBy("t.label", bin_no.alias("bin")).count().collect()
        for label, (g, lo, width, rank, _) in list(open_targets.items()):
            bins = {r["bin"]: r["count"] for r in counts if r["label"] == str(label)}
            at, rank, inside = _locate(bins, rank)
            open_targets[label] = (g, lo + at * width / BINS, width / BINS, rank, inside)

    if open_targets:
        key_names = [f"k{i}" for i in range(len(key_cols))]
        order = Window.partitionBy("t.label").orderBy("d", *key_names)
        last = (
            _targeted(near, open_targets)
            .withColumns({"r": F.row_number().over(order), "tied": F.coalesce(F.lead("d").over(order) == F.col("d"), F.lit(False))})
            .where(F.col("r") == F.col("t.rank"))
            .select("t.label", "d", "tied", *key_names)
            .collect()
        )
        by_label = {r["label"]: r for r in last}
        for label, (g, *_) in open_targets.items():
            r = by_label[str(label)]
            result[label] = Cutoff(result[label].size, g, False, r["d"], tuple(r[k] for k in key_names), r["tied"])
    return totals, result


def smallest(
    df: DataFrame, draw: Column, key_cols: Sequence[str], size: Callable[[int], int], spread=None
) -> tuple[int, Cutoff]:
    """Cutoff of the ``size(row count)`` smallest rows of the whole table, and the row count."""
    totals, cut = cutoffs(df, draw, key_cols, lambda t: {"all": (None, size(t.get(None, 0)))}, spread=spread)
    return totals.get(None, 0), cut["all"]


def weight_spread(draw: Column) -> Column:
    """Monotone map of an exponential draw divided by a weight into [0, 1)."""
    return F.least(F.greatest((F.ln(draw) + 64.0) / 128.0, F.lit(0.0)), F.lit(1.0 - 2.0**-20))


def _locate(bins: dict, n: int) -> tuple[int, int, int]:
    below = 0
    for b in sorted(bins):
        if below + bins[b] >= n:
            return b, n - below, bins[b]
        below += bins[b]
    raise ValueError("rank beyond the histogram")


def _targeted(rows: DataFrame, targets: dict) -> DataFrame:
    """Rows inside a target's interval, once per target ``t`` (intervals of two targets may coincide)."""
    group_type = rows.schema["g"].dataType
    listed = F.array(*[
        F.struct(F.lit(str(label)).alias("label"), F.lit(g).cast(group_type).alias("g"), F.lit(low).alias("low"),
                 F.lit(width).alias("width"), F.lit(rank).alias("rank"))
        for label, (g, low, width, rank, _) in targets.items()])
    group, s = F.col("g"), F.col("s")
    hits = F.filter(listed, lambda t: t["g"].eqNullSafe(group) & (s >= t["low"]) & (s < t["low"] + t["width"]))
    return rows.withColumn("t", F.explode(hits))
