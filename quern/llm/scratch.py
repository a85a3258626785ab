"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster.  Where it is unset and
the master is local, a folder on this machine is taken; on a cluster an unset
folder is an error, as no other place is sure to be seen by all executors.

Disk is given back early: ``discard`` deletes a table that nothing will read any
more, and after each written table the driver's JVM collects its garbage, upon
which Spark deletes the shuffle files of plans that have ended.  Left to itself it
does so every half hour, and a chain of stages would hold all its shuffles at once.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; deleted when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quern-"))
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/quern-{app}"
    fs, path = _fs(spark, folder)
    fs.deleteOnExit(path)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    """(file system, path) in the JVM."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._quern_path = path
    del df, writer
    gc.collect(0)
    spark.sparkContext._jvm.System.gc()
    return table


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote; nothing that is still to run may read them."""
    for table in tables:
        delete(table.sparkSession, table._quern_path)
