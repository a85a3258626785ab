"""Files in and out: snapshots, JSON lines, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import stages

REPORT_ROWS = 10_000


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    return next((p for p in paths if exists(spark, p)), None)


def known_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The ids of a table, no other column read; none if it is not there."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} string")
    return spark.read.parquet(path).select(key).distinct()


def read_snapshots(spark: SparkSession, root: str, *dates: str) -> DataFrame:
    """The snapshot table of ``write_snapshot``, by column name, or the partitions of some dates alone."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}/snapshots").withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return rows.where(F.col("snapshot_date").isin([F.lit(d).cast("date") for d in dates])) if dates else rows


def read_dated(spark: SparkSession, root: str) -> DataFrame:
    """All ``<date>/jobs.parquet`` below a folder, as other writers leave them, with ``snapshot_date`` from the file's path."""
    pattern = f"{root.rstrip('/')}/[0-9][0-9][0-9][0-9]*/jobs.parquet"
    rows = spark.read.option("mergeSchema", "true").parquet(pattern)
    return rows.select("*", F.regexp_extract("_metadata.file_path", r"/(\d{4}-\d{2}-\d{2})/jobs\.parquet", 1).cast("date").alias("snapshot_date"))


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that was written last."""
    folder = f"{root.rstrip('/')}/latest"
    fs, where = stages.file_system(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(where))
    return read_snapshots(spark, root, stages.read_text(spark, f"{folder}/{names[-1]}"))


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines; malformed lines and lines without a required field are skipped."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)
    good = rows.where(F.col("_bad").isNull()).drop("_bad")
    for name in required:
        good = good.where(F.col(name).isNotNull())
    return good


def last_by_key(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")


def write_snapshot(df: DataFrame, root: str, date: str) -> None:
    """One date's partition of the snapshot table, in place of what that date held; other dates are not touched.

    ``latest`` is a pointer, a new small file a write, and no second copy: a reader sees the old one or the new one.
    """
    spark = df.sparkSession
    own = df.drop("snapshot_date").withColumn("snapshot_date", F.lit(date))
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(f"{root.rstrip('/')}/snapshots")
    folder = f"{root.rstrip('/')}/latest"
    fs, where = stages.file_system(spark, folder)
    number = len(fs.listStatus(where)) if fs.exists(where) else 0
    while not stages.create_once(spark, f"{folder}/{number:010d}", date):
        number += 1


def write_curated(active: DataFrame, history: DataFrame, root: str) -> None:
    active.write.mode("overwrite").parquet(f"{root.rstrip('/')}/active")
    history.write.mode("overwrite").parquet(f"{root.rstrip('/')}/history")


def coverage(df: DataFrame) -> DataFrame:
    """How many rows carry each prediction of the enriched table."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("seniority_label_v1") != "unknown").alias("n_seniority"), F.count_if(F.col("role_family_v1") != "unknown").alias("n_role_family"), F.count_if(F.col("predicted_salary_usd_v1").isNotNull() & ~F.isnan("predicted_salary_usd_v1")).alias("n_salary"))


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes doubled, floats to four places."""
    floats = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    df.withColumns({c: F.round(c, 4) for c in floats}).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_jsonl_shards(df: DataFrame, path: str, rows: int, key: str) -> None:
    """JSON lines in key order, ``shard=00000`` and on, each of exactly ``rows`` rows but the last.

    Rows are sorted and written once; a row's number is its place in its sorted file and the sizes of the files before,
    so no task sees more than a file.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}.sorted"
    df.orderBy(key).write.mode("overwrite").parquet(staged)
    ordered = spark.read.schema(df.schema).parquet(staged).withColumn("_file", F.input_file_name())
    before, total = {}, 0
    # One number a file.
    for one in ordered.groupBy("_file").agg(F.count("*").alias("n"), F.min(key).alias("k")).orderBy("k", "_file").collect():
        before[one["_file"]], total = total, total + one.n
    offsets = spark.createDataFrame(list(before.items()), "_file string, _before long")
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_file").orderBy(key, *(c for c in df.columns if c != key))) - 1
    dealt = ordered.join(F.broadcast(offsets), "_file").withColumn("_n", number).withColumn("shard", F.lpad(F.floor(F.col("_n") / rows).cast("string"), 5, "0"))
    dealt.repartition("shard").sortWithinPartitions("shard", "_n").select(*df.columns, "shard").write.mode("overwrite").partitionBy("shard").json(path)


def report_json(df: DataFrame, most: int = REPORT_ROWS) -> str:
    """A small result as indented JSON; a larger one than ``most`` rows is an error."""
    return json.dumps([r.asDict(recursive=True) for r in _few(df, most)], indent=2, default=str)


def report_markdown(df: DataFrame, title: str, most: int = REPORT_ROWS) -> str:
    """A small result as a markdown table."""
    rows = [[str(v) for v in r] for r in _few(df, most)]
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows])


def _few(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


# Fixed value: the namespace of chunk ids.
NAMESPACE = "4f3a9b321d2c4f4e8f2a9b3c4d5e6f70"


def point_id(chunk: Column) -> Column:
    """The version 5 UUID of a chunk's name."""
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE)), F.encode(chunk, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
