"""Error-proxy score of a row: share of outlying numeric cells plus share of missing numeric cells.

The score has at most (M+1)(M+2)/2 values for M numeric columns, whatever the row count.  One grouped count over
(outlying cells, missing cells) therefore yields every statistic the samplers need (row count, quantiles, sums,
deviations per stratum) exactly, from a table bounded by the schema.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double
from .profile import count_nulls, table_fences
from .table import AuditTable

EPSILON = 1e-6


@dataclass(frozen=True)
class CellRules:
    """Fences of the numeric columns as literals, so that the score is a plain expression inside any scan."""

    columns: tuple[str, ...]
    bounds: tuple[tuple[float | None, float | None], ...]

    @classmethod
    def of(cls, t: AuditTable, rule: str = "proxy") -> CellRules:
        columns = tuple(t.numeric)
        if not columns:
            return cls((), ())
        row = table_fences(t, rule).first()
        return cls(columns, tuple((row[f"low_{i}"], row[f"high_{i}"]) for i in range(len(columns))))

    def outlying(self) -> list[Column]:
        flags = []
        for c, (low, high) in zip(self.columns, self.bounds):
            if low is not None:
                flags.append(F.coalesce((as_double(c) < F.lit(low)) | (as_double(c) > F.lit(high)), F.lit(False)))
        return flags

    def outlying_cells(self) -> Column:
        total = F.lit(0)
        for flag in self.outlying():
            total = total + flag.cast("int")
        return total

    def missing_cells(self) -> Column:
        return count_nulls(self.columns)

    def score(self) -> Column:
        if not self.columns:
            return F.lit(0.0)
        m = F.lit(float(len(self.columns)))
        return self.outlying_cells() / m + self.missing_cells() / m


def error_proxy(t: AuditTable) -> DataFrame:
    """Key columns and ``score`` of every row."""
    return t.df.select(*t.key_cols, CellRules.of(t).score().alias("score"))


@dataclass(frozen=True)
class ScoreCounts:
    """Distribution of the score: ((score, rows), ...) in increasing score order."""

    counts: tuple[tuple[float, int], ...]

    @cached_property
    def rows(self) -> int:
        return sum(n for _, n in self.counts)

    def total(self, value=lambda s: s) -> float:
        return math.fsum(value(s) * n for s, n in self.counts)

    def deviation(self) -> float:
        """Population standard deviation, 0 for at most one row."""
        if self.rows <= 1:
            return 0.0
        mean = self.total() / self.rows
        return math.sqrt(self.total(lambda s: (s - mean) ** 2) / self.rows)

    def at_rank(self, rank: int) -> float:
        below = 0
        for s, n in self.counts:
            below += n
            if rank < below:
                return s
        return self.counts[-1][0]

    def quantile(self, p: float) -> float:
        at = (self.rows - 1) * p
        low, high = self.at_rank(math.floor(at)), self.at_rank(math.ceil(at))
        return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high


def score_counts(df: DataFrame, rules: CellRules, group: Column | None = None) -> dict:
    """Score distribution per value of ``group`` (a column with few values)."""
    rows = df.select(
        (F.lit(None).cast("int") if group is None else group).alias("g"),
        rules.outlying_cells().alias("o"), rules.missing_cells().alias("m"),
    ).groupBy("g", "o", "m").count().collect()
    m = float(max(len(rules.columns), 1))
    out: dict = {}
    for r in rows:
        values = out.setdefault(r["g"], {})
        score = r["o"] / m + r["m"] / m
        values[score] = values.get(score, 0) + r["count"]
    found = {g: ScoreCounts(tuple(sorted(v.items()))) for g, v in out.items()}
    if group is None:
        found.setdefault(None, ScoreCounts(()))
    return found


def inverse_weight(score: Column) -> Column:
    return F.lit(1.0) / (score + EPSILON)


def weight_cap(sample: ScoreCounts, clip: float | None = 0.95) -> float | None:
    """The ``clip`` quantile of 1/(score + 1e-6) over a sample; ``None`` for no clipping."""
    if clip is None or not sample.rows:
        return None
    weights = ScoreCounts(tuple(sorted((1.0 / (s + EPSILON), n) for s, n in sample.counts)))
    return weights.quantile(clip)


def clipped_weight(score: Column, sample: ScoreCounts, clip: float | None = 0.95) -> Column:
    """Inverse-score weight, capped at its own quantile and normalised to sum 1 over the sample."""
    cap = weight_cap(sample, clip)

    def capped(s: float) -> float:
        w = 1.0 / (s + EPSILON)
        return w if cap is None or cap <= 0 else min(w, cap)

    total = sample.total(capped)
    raw = inverse_weight(score)
    limited = raw if cap is None or cap <= 0 else F.least(raw, F.lit(cap))
    return limited / F.lit(total if total > 0 else 1.0)


def clip_sweep_weights(score: Column, sample: ScoreCounts, clips: Sequence[float | None]) -> Column:
    """Array of (clip label, weight): one row feeds every clip level, so one scan serves the whole sweep."""
    return F.array(*[
        F.struct(F.lit(clip_label(c)).alias("clip_percentile"), clipped_weight(score, sample, c).alias("w")) for c in clips
    ])


def clip_label(clip: float | None) -> str:
    return "none" if clip is None else str(round(clip * 100))
