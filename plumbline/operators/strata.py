"""Strata by defect type or score quantile, and Neyman allocation of a budget over them."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import any_of
from .score import CellRules, ScoreCounts, score_counts
from .storage import small_table
from .table import AuditTable


@dataclass(frozen=True)
class Stratum:
    stratum: int
    n_rows: int
    deviation: float
    allocated: int


def defect_type_stratum(t: AuditTable) -> Column:
    """0: a numeric cell is missing or outside Tukey fences; 1: a categorical cell is missing; 2: neither."""
    numeric = CellRules.of(t, "tukey")
    bad_number = any_of([*numeric.outlying(), *[F.col(f"`{c}`").isNull() for c in t.numeric]])
    bad_label = any_of([F.col(f"`{c}`").isNull() for c in t.categorical])
    return F.when(bad_number, 0).when(bad_label, 1).otherwise(2)


def score_thresholds(scores: ScoreCounts, n_strata: int = 3) -> list[float]:
    return [scores.quantile(i / n_strata) for i in range(n_strata)]


def score_stratum(score: Column, thresholds: Sequence[float]) -> Column:
    """Number of the last threshold at or below the score; equal thresholds leave the earlier stratum empty."""
    stratum = F.lit(0)
    for i, threshold in enumerate(thresholds[1:], start=1):
        stratum = F.when(score >= F.lit(threshold), i).otherwise(stratum)
    return stratum


def neyman(per_stratum: dict[int, ScoreCounts], n: int, n_strata: int, min_per_stratum: int = 0) -> list[Stratum]:
    """``floor(n N_h S_h / sum)`` each, proportional to N_h if no stratum varies; the remainder goes one by one to the
    largest strata, and nothing exceeds the stratum.  ``min_per_stratum`` lifts strata that would get too little."""
    empty = ScoreCounts(())
    strata = [per_stratum.get(h, empty) for h in range(n_strata)]
    sizes = [s.rows for s in strata]
    deviations = [s.deviation() for s in strata]
    weights = [size * dev for size, dev in zip(sizes, deviations)]
    if sum(weights) == 0:
        weights = [float(size) for size in sizes]
    total = sum(weights)
    allocated = [math.floor(n * w / total) if total else 0 for w in weights]
    by_size = sorted(range(n_strata), key=lambda h: (-sizes[h], h))
    for i in range(n - sum(allocated)):
        allocated[by_size[i % n_strata]] += 1
    allocated = [min(max(a, min_per_stratum), size) for a, size in zip(allocated, sizes)]
    return [Stratum(h, sizes[h], deviations[h], allocated[h]) for h in range(n_strata)]


def stratify(t: AuditTable, by: str = "quality", n_strata: int = 3) -> tuple[Column, dict[int, ScoreCounts], int]:
    """The stratum expression, the score distribution per stratum, and the number of strata."""
    rules = CellRules.of(t)
    if by == "column":
        stratum, n_strata = defect_type_stratum(t), 3
    elif by == "quality":
        thresholds = score_thresholds(score_counts(t.df, rules)[None], n_strata)
        stratum = score_stratum(rules.score(), thresholds)
    else:
        raise ValueError(f"unknown stratification {by!r}")
    return stratum, score_counts(t.df, rules, stratum), n_strata


def allocation_table(t: AuditTable, budget: float, by: str = "quality", n_strata: int = 3) -> DataFrame:
    """(stratum, n_rows, deviation, allocated), one row per stratum."""
    _, scores, count = stratify(t, by, n_strata)
    n = max(1, int(sum(s.rows for s in scores.values()) * budget))
    rows = [(s.stratum, s.n_rows, s.deviation, s.allocated) for s in neyman(scores, n, count)]
    return small_table(t.df.sparkSession, rows, "stratum int, n_rows bigint, deviation double, allocated bigint")
