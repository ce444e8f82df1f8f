"""Named datasets: how to read a table, what identifies its rows, and which dependencies it should obey."""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.samplers import fixed_size
from ..operators.table import AuditTable, audit
from .cache import path_exists, read_truth


@dataclass(frozen=True)
class Dataset:
    """``paths`` are tried in order; the first that exists is read (Parquet unless ``reader`` says otherwise)."""

    paths: tuple[str, ...]
    key_cols: tuple[str, ...] | None = None
    rules: Mapping | tuple = ()
    reader: Callable[[SparkSession, str], DataFrame] = field(default=lambda spark, path: spark.read.parquet(path))
    truth_path: str | None = None


class Catalog:
    def __init__(self, datasets: Mapping[str, Dataset]):
        self.datasets = dict(datasets)

    def load(self, spark: SparkSession, name: str, n_records: int | None = None, seed: int = 42) -> tuple[AuditTable, DataFrame | None]:
        """The audited table, capped at ``n_records`` random rows, and its stored ground truth if there is one.

        Stored truth describes the whole table, so a capped table has none.
        """
        if name not in self.datasets:
            raise ValueError(f"unknown dataset {name!r}; known: {sorted(self.datasets)}")
        entry = self.datasets[name]
        path = first_existing(spark, entry.paths)
        t = audit(entry.reader(spark, path), entry.key_cols, rules=entry.rules, name=name)
        t = replace(t, origin=path)
        if n_records is not None:
            return replace(fixed_size(t, n_records, seed).table, origin=f"{path}/{n_records} rows/seed {seed}"), None
        truth = None
        if entry.truth_path and path_exists(spark, entry.truth_path):
            truth = read_truth(spark, entry.truth_path)
        return t, truth


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exist: {', '.join(paths)}")


def folder_catalog(folder: str, tables: Mapping[str, Mapping]) -> Catalog:
    """One Parquet table per name in a folder; options as in :class:`Dataset`."""
    return Catalog({name: Dataset((f"{folder.rstrip('/')}/{name}.parquet",), **options) for name, options in tables.items()})
