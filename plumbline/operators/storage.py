"""Cutting lineage: a table written once to shared storage keeps column pruning and pushdown, unlike a cached RDD.

The folder is the cluster's ``spark.checkpoint.dir``.  Only a local session without that setting gets a temporary
folder of its own; on a cluster a machine-local folder would be lost with its machine, so that is an error.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _local_folders[app]


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A bounded list of rows as a local relation (through Arrow, so no Python task reads it)."""
    names = StructType.fromDDL(schema).names
    columns = list(zip(*rows)) or [()] * len(names)
    table = pa.table({n: pa.array(list(c)) for n, c in zip(names, columns)}) if rows else None
    if table is None:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(table).to(StructType.fromDDL(schema))


def spread(scan: DataFrame) -> DataFrame:
    """Spread a plain file scan over all cores if it comes in fewer pieces (small tables, or one unsplittable file).

    A table of many files has more pieces than cores and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
