"""Running totals over any number of rows: sums inside blocks, and sums of the blocks before.

A window over a whole table sorts it in one task.  Here the rows fall into blocks of BLOCK consecutive numbers; a
window runs inside each block, and only one row per block goes through the window over all blocks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384


def totals_before(df: DataFrame, number: str, values: Sequence[str], prefix: str = "before_", rows: int | None = None, block: int = BLOCK) -> DataFrame:
    """Adds ``before_<value>``: the sum of ``value`` over all rows with a smaller ``number`` (unique, from 0 without large gaps).

    ``rows`` is the number of rows if it is known; no more than one block needs no second level.
    """
    if rows is not None and rows <= block:
        before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"{prefix}{v}": F.coalesce(F.sum(v).over(before), F.lit(0)) for v in values})
    at = F.floor(F.col(number) / block).cast("bigint")
    numbered = df.withColumn("__block", at)
    blocks = numbered.groupBy("__block").agg(*[F.sum(v).alias(f"__sum_{v}") for v in values])
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("__block", *[F.coalesce(F.sum(f"__sum_{v}").over(earlier), F.lit(0)).alias(f"__offset_{v}") for v in values])
    inside = Window.partitionBy("__block").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    ran = numbered.withColumns({f"__inside_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    joined = ran.join(offsets, "__block")
    return joined.select(*df.columns, *[(F.col(f"__offset_{v}") + F.col(f"__inside_{v}")).alias(f"{prefix}{v}") for v in values])
