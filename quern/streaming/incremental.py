"""Snapshots as a stream: new files are folded into the lineage of ids, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import exists


def read_stream(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(root)


def merged_lineage(old: DataFrame | None, batch: DataFrame, key: str = "id") -> DataFrame:
    """First and last dates and times seen, after a batch of (key, snapshot_date)."""
    new = batch.groupBy(key).agg(F.min("snapshot_date").alias("first_seen_at"), F.max("snapshot_date").alias("last_seen_at"), F.count("*").alias("times_seen"))
    return new if old is None else _merged(old.unionByName(new), key)


def _parts(spark: SparkSession, state: str) -> dict[str, list[int]]:
    """Numbers of the whole tables of each kind below ``state``; a table that is being written has no mark of success yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"base": [], "delta": []}
    if fs.exists(folder):
        for one in fs.listStatus(folder):
            kind, _, number = one.getPath().getName().partition("=")
            if kind in out and exists(spark, f"{state}/{kind}={number}/_SUCCESS"):
                out[kind].append(int(number))
    return {kind: sorted(numbers) for kind, numbers in out.items()}


def lineage(spark: SparkSession, state: str, key: str = "id", upto: int | None = None) -> DataFrame | None:
    """First and last dates and times seen of every key: the last base and the deltas after it; None before the first batch."""
    parts = _parts(spark, state)
    within = lambda numbers: [n for n in numbers if upto is None or n <= upto]
    base = within(parts["base"])[-1:]
    deltas = [n for n in within(parts["delta"]) if not base or n > base[0]]
    paths = [f"{state}/base={n:08d}" for n in base] + [f"{state}/delta={n:08d}" for n in deltas]
    if not paths:
        return None
    rows = spark.read.parquet(paths[0])
    for path in paths[1:]:
        rows = rows.unionByName(spark.read.parquet(path))
    return _merged(rows, key)


def _merged(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("times_seen").alias("times_seen"))


def compact(spark: SparkSession, state: str, number: int, key: str = "id") -> None:
    """Fold everything up to a batch into one base, then delete what it holds; a repeated compaction gives the same."""
    rows = lineage(spark, state, key, number)
    if rows is None:
        return
    old = _parts(spark, state)
    if number not in old["base"]:
        rows.write.mode("overwrite").parquet(f"{state}/base={number:08d}")
    for kind, numbers in old.items():
        for n in numbers:
            if n < number or (kind == "delta" and n == number):
                folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state}/{kind}={n:08d}")
                folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fold_snapshots(spark: SparkSession, root: str, schema: T.StructType, state: str, checkpoint: str, key: str = "id", every: int = 16) -> None:
    """Fold all files that are new below ``root`` into ``state``, which ``lineage`` reads.

    A batch writes its own delta and nothing else, so it costs what it brings; a repeated batch overwrites its delta, or,
    once a base holds it, is left out.  Each ``every`` batches are compacted, and what they were is deleted.
    """

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        if any(n >= number for n in _parts(own, state)["base"]):
            return
        merged_lineage(None, batch, key).write.mode("overwrite").parquet(f"{state}/delta={number:08d}")
        if (number + 1) % every == 0:
            compact(own, state, number, key)

    query = read_stream(spark, root, schema).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by time window, events later than ``late`` left out."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def first_seen(events: DataFrame, time: str, late: str, key: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])
