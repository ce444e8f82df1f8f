"""Write-once tables and ground truth, keyed by all the parameters they depend on."""
from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from ..operators.profile import INDICATORS, profile_table
from ..operators.storage import materialise, shared_folder
from ..operators.table import AuditTable

__all__ = ["cached_table", "materialise", "parameter_key", "path_exists", "read_truth", "shared_folder", "truth_profile"]


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path exists in whatever file system it names."""
    files, target = _file_system(spark, path)
    return files.exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def parameter_key(**parameters) -> str:
    """Short name that differs whenever any parameter does."""
    text = json.dumps(parameters, sort_keys=True, default=str)
    return hashlib.sha1(text.encode()).hexdigest()[:16]


def cached_table(spark: SparkSession, root: str, name: str, build, force: bool = False, **parameters) -> DataFrame:
    """Read ``root/name-<parameters>`` or build and write it first; ``force`` builds it again.

    A table counts as present only with its ``_SUCCESS`` marker, so a build that died half way is repeated.
    """
    path = f"{root.rstrip('/')}/{name}-{parameter_key(**parameters)}"
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth profile from JSON: the four rates and, if stored, the sizes."""
    schema = ", ".join(f"{i} double" for i in INDICATORS) + ", sample_size bigint, n_records bigint"
    return spark.read.schema(schema).json(path)


def truth_profile(t: AuditTable, root: str, force: bool = False, **parameters) -> DataFrame:
    """Full-scan profile, computed once per table, rules, columns and parameters, and kept as JSON.

    A table is its name and its origin: a capped or derived table never gets the truth of the whole one.
    """
    spark = t.df.sparkSession
    rules = [[list(r.determinant), r.dependent] for r in t.rules]
    key = parameter_key(table=t.name, origin=t.origin, rules=rules, columns=t.measured, **parameters)
    path = f"{root.rstrip('/')}/{t.name}-truth-{key}"
    if force or not path_exists(spark, f"{path}/_SUCCESS"):
        profile_table(t).coalesce(1).write.mode("overwrite").json(path)
    return read_truth(spark, path)
