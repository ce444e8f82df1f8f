"""A table as a log of versions: data folders, and manifests that name the folders each version consists of.

Data are written to a new folder first; a version exists once its manifest does.  A manifest is created only if no file of its number
exists (the file system decides between two writers) and counts only if it is complete, so a writer that dies at any step
leaves the version before it in force.  Nothing a manifest names is changed or moved; ``vacuum`` removes what no longer counts.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .cache import _file_system, delete_path

LOG, DATA, DIGITS = "log", "data_folder", 12  # data folders look like partitions, so several can be read at once


class Conflict(Exception):
    """Another writer committed a version of this number."""


def _manifest(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/{LOG}/{version:0{DIGITS}d}.json"


def _children(spark: SparkSession, path: str) -> list[str]:
    files, target = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


def _read(spark: SparkSession, path: str) -> list[str] | None:
    """Folders of a manifest; None if its writer died before it was complete."""
    files, target = _file_system(spark, path)
    stream = files.open(target)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)["folders"]
    except (ValueError, KeyError):
        return None


def latest(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """(highest number in use, folders of the newest complete version); (0, []) before the first."""
    numbers = [int(name.split(".")[0]) for name in _children(spark, f"{path.rstrip('/')}/{LOG}") if name.endswith(".json") and not name.startswith(".")]
    for version in sorted(numbers, reverse=True):
        folders = _read(spark, _manifest(path, version))
        if folders is not None:
            return max(numbers), folders
    if not numbers and any(("=" in name and not name.startswith(f"{DATA}=")) or name.endswith(".parquet") for name in _children(spark, path)):
        raise ValueError(f"{path} holds a table without versions")
    return max(numbers, default=0), []


def commit(spark: SparkSession, path: str, version: int, folders: list[str]) -> None:
    """Make ``folders`` version ``version``, unless a file of that number exists."""
    files, target = _file_system(spark, _manifest(path, version))
    if files.exists(target):
        raise Conflict(path)
    try:
        stream = files.create(target, False)
    except Exception as e:
        if files.exists(target):
            raise Conflict(path) from e
        raise
    stream.write(bytearray(json.dumps({"folders": folders}).encode()))
    stream.close()


def write_folder(rows: DataFrame, path: str, partition_by: str) -> str:
    """Write a data folder that no version names yet."""
    folder = f"{DATA}=f{uuid.uuid4().hex}"
    rows.write.partitionBy(partition_by).parquet(f"{path.rstrip('/')}/{folder}")
    return folder


def change(spark: SparkSession, path: str, step: Callable[[list[str]], list[str]], attempts: int = 20) -> None:
    """Commit ``step(folders of the newest version)``; where another writer was faster, again from its version."""
    for _ in range(attempts):
        version, folders = latest(spark, path)
        try:
            return commit(spark, path, version + 1, step(folders))
        except Conflict:
            continue
    raise Conflict(f"{path}: {attempts} attempts")


def read_folders(spark: SparkSession, path: str, folders: list[str], schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    root = path.rstrip("/")
    return reader.option("mergeSchema", schema is None).option("basePath", root).parquet(*[f"{root}/{f}" for f in folders]).drop(DATA)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove data folders that the newest version does not name; only while nobody writes or reads an older version."""
    _, folders = latest(spark, path)
    stale = [name for name in _children(spark, path) if name.startswith(f"{DATA}=") and name not in folders]
    for name in stale:
        delete_path(spark, f"{path.rstrip('/')}/{name}")
    return stale


__all__ = ["Conflict", "change", "commit", "latest", "read_folders", "vacuum", "write_folder"]
