"""Tables between stages: written once to the shared folder, named by their input, and read by whoever asks for the same again.

``spark.checkpoint.dir`` names the folder on a cluster.  Where it is unset and the master is
local, a folder on this machine is taken; on a cluster an unset folder is an error.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quern-stages-")
        fs, path = file_system(spark, _LOCAL[app])
        fs.deleteOnExit(path)
    return _LOCAL[app]


def file_system(spark: SparkSession, path: str):
    """(file system, path) in the JVM, whatever store the path is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that nobody may replace.  False if it is there already: only one writer can commit."""
    fs, where = file_system(spark, path)
    try:
        out = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def fingerprint(inputs: DataFrame | list[DataFrame], *parameters: object) -> str:
    """A name for what is made of these tables' files with these parameters: another file, size or time gives another one."""
    tables = inputs if isinstance(inputs, list) else [inputs]
    seen: list[object] = [repr(p) for p in parameters]
    for table in tables:
        spark, read = table.sparkSession, {}
        for path in table.inputFiles():
            folder, name = path.rsplit("/", 1)
            read.setdefault(folder, set()).add(name)
        for folder, names in sorted(read.items()):
            fs, where = file_system(spark, folder)
            known = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where))
            seen.append([folder, [k for k in known if k[0] in names]])
        seen.append(table.schema.json())
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()[:24]


def staged(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame], folder: str | None = None) -> DataFrame:
    """The table ``name`` for ``key``: read if it has been committed, else built, written and committed.

    A table is written under a name of its own and then named in a commit file that can be created but not replaced, so a
    table that is half written is never read, and of several writers one counts.
    """
    home = f"{folder or shared_folder(spark)}/stages/{name}-{key}"
    if not _exists(spark, f"{home}/_committed"):
        mine = f"data-{uuid.uuid4().hex}"
        build().write.parquet(f"{home}/{mine}")
        if not create_once(spark, f"{home}/_committed", mine):
            delete(spark, f"{home}/{mine}")
    return spark.read.parquet(f"{home}/{read_text(spark, f'{home}/_committed')}")


def temporary(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again; the file system deletes it when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/temporary/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return fs.exists(where)
