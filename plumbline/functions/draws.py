"""Repeatable random draws: every draw is a hash of (seed, tag, row key).

A draw does not depend on partitioning, retries or row order, so a lost executor recomputes the same sample, and
any SQL engine with md5 can check it.  ``rand(seed)`` and ``DataFrame.sample`` have neither property.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2**52)
HALF_STEP = 2.0**-53  # keeps ln(u) finite at u = 0


def _text(key: str | Column) -> Column:
    column = F.col(f"`{key}`") if isinstance(key, str) else key
    return F.coalesce(column.cast("string"), F.lit("<null>"))


@dataclass(frozen=True)
class Draws:
    """A family of draws under one seed.

    ``algorithm="md5"`` can be replayed by other engines; ``"xxhash64"`` is several times cheaper per row.
    ``seed`` may be a Column, so that one scan can serve many seeds.
    """

    seed: int | Column
    algorithm: str = "md5"

    def __post_init__(self):
        if self.algorithm not in ("md5", "xxhash64"):
            raise ValueError(f"unknown draw algorithm {self.algorithm!r}")

    def uniform(self, tag: str | Column, *keys: str | Column, half: int = 0) -> Column:
        """Uniform on [0, 1) with 52 bits.  ``half=1`` is a second, independent draw from the same hash."""
        if self.algorithm == "xxhash64":
            seed = self.seed if isinstance(self.seed, Column) else F.lit(str(self.seed))
            hashed = F.xxhash64(F.lit(half), seed.cast("string"), F.lit(tag), *[_text(k) for k in keys])
            return F.shiftrightunsigned(hashed, 12).cast("double") / F.lit(TWO52)
        return F.conv(self._digits(tag, *keys, half=half), 16, 10).cast("bigint") / F.lit(TWO52)

    def _digits(self, tag: str | Column, *keys: str | Column, half: int = 0) -> Column:
        """The 13 hex digits of a draw.  The text of the keys is one expression, which many draws of a row share."""
        plain = not isinstance(self.seed, Column) and not isinstance(tag, Column)
        seed = self.seed if isinstance(self.seed, Column) else F.lit(str(self.seed))
        parts = [F.lit(f"{self.seed}|{tag}")] if plain else [seed.cast("string"), F.lit(tag)]
        if keys:
            parts.append(F.concat_ws("|", *[_text(k) for k in keys]))
        return F.substring(F.md5(F.concat_ws("|", *parts)), 1 + 13 * half, 13)

    def below(self, share: float, tag: str | Column, *keys: str | Column) -> Column:
        """``uniform(tag, *keys) < share``, without turning the digits into a number: equally long digits sort as numbers do."""
        if self.algorithm == "xxhash64" or share != share:
            return self.uniform(tag, *keys) < share
        first = math.ceil(min(max(share, 0.0), 1.0) * TWO52)  # the smallest draw that is not below
        if first in (0, 2**52):
            return F.lit(first > 0)
        return self._digits(tag, *keys) < F.lit(f"{first:013x}")

    def exponential(self, tag: str | Column, *keys: str | Column) -> Column:
        return -F.ln(self.uniform(tag, *keys) + F.lit(HALF_STEP))

    def normal(self, tag: str, *keys: str | Column) -> Column:
        """Standard normal by the Box-Muller transform of the two halves of one hash."""
        radius = F.sqrt(F.lit(-2.0) * F.ln(self.uniform(tag, *keys) + F.lit(HALF_STEP)))
        return radius * F.cos(F.lit(2.0 * math.pi) * self.uniform(tag, *keys, half=1))

    def integer(self, n: int, tag: str, *keys: str | Column) -> Column:
        """Uniform on 0 .. n-1."""
        return F.floor(self.uniform(tag, *keys) * F.lit(float(n))).cast("int")

    def choice(self, values: Sequence, tag: str, *keys: str | Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.integer(len(values), tag, *keys) + 1)

    def sign(self, tag: str, *keys: str | Column) -> Column:
        return F.when(self.below(0.5, tag, *keys), F.lit(-1.0)).otherwise(F.lit(1.0))
