"""The table under audit: rows, identity, measured columns and dependency rules."""
from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import categorical_columns, nan_to_null, numeric_columns
from .prefix import totals_before
from .storage import materialise, small_table

COPY = "row_copy"
COPIES_PER_TASK = 100_000
ROWS_PER_RANGE = 1_000_000
POSITION_BINS = 65_536
NEAR_ROWS = 1_000_000  # a table of so many rows is sorted as a whole


@dataclass(frozen=True)
class FdRule:
    """``determinant -> dependent``: equal determinants must have equal dependents."""

    determinant: tuple[str, ...]
    dependent: str


def fd_rules(rules: Mapping | Iterable | None) -> tuple[FdRule, ...]:
    """Accepts ``{"a": "b"}``, ``[("a", "b")]``, ``[(("a", "b"), "c")]`` or FdRule objects."""
    pairs = rules.items() if isinstance(rules, Mapping) else (rules or ())
    out = []
    for rule in pairs:
        if not isinstance(rule, FdRule):
            det, dep = rule
            rule = FdRule((det,) if isinstance(det, str) else tuple(det), dep)
        out.append(rule)
    return tuple(out)


@dataclass(frozen=True)
class AuditTable:
    """Built by :func:`audit`; ``measured`` columns enter the indicators, ``key_cols`` only identify rows."""

    df: DataFrame
    key_cols: tuple[str, ...]
    measured: tuple[str, ...]
    rules: tuple[FdRule, ...] = ()
    name: str = "unknown"
    known_rows: int | None = field(default=None, compare=False)
    origin: str = ""  # what the rows are, beyond the name: source, cap, seed, or that they were derived

    @cached_property
    def rows(self) -> int:
        return self.df.count() if self.known_rows is None else self.known_rows

    @property
    def numeric(self) -> list[str]:
        return numeric_columns(self.df, self.measured)

    @property
    def categorical(self) -> list[str]:
        return categorical_columns(self.df, self.measured)

    def with_rows(self, df: DataFrame, known_rows: int | None = None, origin: str | None = None) -> AuditTable:
        return replace(self, df=df, known_rows=known_rows, origin=f"{self.origin}/derived" if origin is None else origin)


def audit(
    df: DataFrame,
    key_cols: Sequence[str] | None = None,
    measured: Sequence[str] | None = None,
    rules: Mapping | Iterable | None = None,
    name: str = "unknown",
) -> AuditTable:
    """Normalise a DataFrame for profiling and sampling.

    ``key_cols`` must identify a row.  Without them each set of identical rows is numbered (:func:`number_copies`).
    Rules that name an absent column are dropped.
    """
    measured = tuple(df.columns if measured is None else measured)
    df = nan_to_null(df)
    if key_cols is None:
        df = number_copies(df)
        key_cols = ("row_h1", "row_h2", COPY)
    usable = tuple(r for r in fd_rules(rules) if {*r.determinant, r.dependent} <= set(measured))
    return AuditTable(df, tuple(key_cols), measured, usable, name)


def null_mask(columns: Sequence[str]) -> list[Column]:
    """Bit masks of the null cells: nulls alone do not change a Spark hash, so (a, NULL) and (NULL, a) would meet."""
    masks = []
    for start in range(0, len(columns), 62):
        bits = [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                for i, c in enumerate(columns[start:start + 62])]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        masks.append(total)
    return masks


def row_hashes(df: DataFrame, columns: Sequence[str]) -> tuple[Column, Column]:
    """128-bit identity of the row's measured content, in two halves with different starting points."""
    types = {f.name: f.dataType.typeName() for f in df.schema}
    cells = [F.array_sort(F.map_entries(F.col(f"`{c}`"))) if types[c] == "map" else F.col(f"`{c}`") for c in columns]
    cells += null_mask(columns) if columns else []
    return F.xxhash64(*cells), F.xxhash64(F.lit("second half"), *cells)


def number_copies(df: DataFrame) -> DataFrame:
    """Give every row of a keyless table an identity: content hash plus a number among identical rows.

    Identical rows are counted (map-side combined) and written out again from the count, so a row that makes up a
    third of the table is neither collected in one task nor numbered by a window; large counts are split first.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    h1, h2 = row_hashes(df, columns)
    pieces = counted.withColumn("row_h1", h1).withColumn("row_h2", h2).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / COPIES_PER_TASK)))
    )
    many = F.col("copies") > COPIES_PER_TASK
    spread = pieces.repartition("row_h1", F.when(many, F.col("piece")).otherwise(F.lit(0)))
    first = F.col("piece") * COPIES_PER_TASK
    last = F.least(F.col("copies"), first + COPIES_PER_TASK)
    return spread.withColumn(COPY, F.explode(F.sequence(first + 1, last))).drop("piece", "copies")


def identified(t: AuditTable) -> bool:
    """Whether no two rows have the same key (as far as 64 bits tell them apart); rows with a NULL in it do not count.  Found once per table."""
    if "_identified" not in vars(t):
        whole = reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in t.key_cols])
        hashed = t.df.where(whole).select(row_hashes(t.df, t.key_cols)[0].alias("h"))
        vars(t)["_identified"] = hashed.groupBy("h").count().where("count > 1").isEmpty()
    return vars(t)["_identified"]


def with_ordinal(t: AuditTable, order_cols: Sequence[str], alias: str = "ordinal", rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, int]:
    """Global 0-based position in (order_cols, key) order, and the row count.

    Spark's range partitioner cuts the order into as many ranges as the number of rows asks for; each range is sorted
    where it lands, so a row's place inside its range is its place in the partition.  Both are written with the row,
    once, which fixes them.  Rows per range are counted and summed up in two levels, and the sums are joined to the rows.
    Keys are unique, so no range holds more than its share, however often one value of the order columns occurs.
    """
    order = [*order_cols, *[k for k in t.key_cols if k not in order_cols]]
    ranges = max(1, math.ceil(t.rows / rows_per_range))
    in_range = t.df.repartitionByRange(ranges, *[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    id_ = F.monotonically_increasing_id()  # partition * 2^33 + place in the partition
    placed = materialise(in_range.withColumn("__at", id_), "ranges").withColumns({
        "range_no": F.shiftright("__at", 33), "__place": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))}).drop("__at")
    sizes = placed.groupBy("range_no").agg(F.count(F.lit(1)).alias("rows"))
    offsets = totals_before(sizes, "range_no", ["rows"], rows=ranges).select("range_no", "before_rows")
    numbered = placed.join(offsets, "range_no").withColumn(alias, F.col("before_rows") + F.col("__place"))
    return numbered.select(*t.df.columns, alias), t.rows


def ordinals_of_blocks(t: AuditTable, order_cols: Sequence[str], block: int, count: int, chosen: Sequence[Column], alias: str = "ordinal",
                       rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The rows with their position as :func:`with_ordinal` numbers them; it may be NULL outside the chosen blocks of ``block`` consecutive rows.

    ``chosen`` are predicates of ``__block``, of which there are ``count``.  A histogram of the first order column tells which
    positions a bin of it covers, so only the rows of bins that reach into a chosen block are sorted.  The other rows stay where they are.
    """
    order = [*order_cols, *[k for k in t.key_cols if k not in order_cols]]
    bins = _position_bins(t, order[0]) if t.rows > NEAR_ROWS and order[0] in numeric_columns(t.df) else None
    if bins is None:
        return with_ordinal(t, order_cols, alias, rows_per_range)[0]
    number, rows = bins
    spark = t.df.sparkSession
    numbers = spark.range(count).withColumnRenamed("id", "__block")
    inside = sorted(r["__block"] for r in numbers.where(reduce(lambda a, b: a | b, chosen)).collect())
    near, before, sorted_rows = [], 0, 0
    for b in sorted(rows):
        if bisect_left(inside, before // block) < bisect_right(inside, (before + rows[b] - 1) // block):
            near.append((b, before - sorted_rows))  # rows before this bin that are not sorted
            sorted_rows += rows[b]
        before += rows[b]
    skipped = F.broadcast(small_table(spark, near, "__bin bigint, __skipped bigint"))
    binned = t.df.withColumn("__bin", number)
    part = t.with_rows(binned.join(skipped, "__bin").drop("__bin"), sorted_rows)
    numbered = with_ordinal(part, order_cols, alias, rows_per_range)[0].withColumn(alias, F.col(alias) + F.col("__skipped")).drop("__skipped")
    rest = binned.join(skipped, "__bin", "left_anti").drop("__bin").withColumn(alias, F.lit(None).cast("bigint"))
    return numbered.unionByName(rest)


def _position_bins(t: AuditTable, column: str) -> tuple[Column, dict[int, int]] | None:
    """The number of a bin that grows with ``column`` (NULLs first), and the rows per bin; None if the column has no two finite bounds."""
    x = F.col(f"`{column}`").cast("double")
    low, high = t.df.agg(F.min(x), F.max(x)).first()
    if low is None or not 0 < high - low < math.inf:
        return None
    place = F.floor((x - F.lit(low)) / F.lit(high - low) * POSITION_BINS)
    number = F.when(x.isNull(), F.lit(-1)).otherwise(F.least(place, F.lit(POSITION_BINS - 1))).cast("bigint")
    return number, {r["b"]: r["count"] for r in t.df.groupBy(number.alias("b")).count().collect()}
