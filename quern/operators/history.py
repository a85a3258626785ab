"""Active and historical postings from dated snapshots, in one window pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_snapshots(parts: list[DataFrame]) -> DataFrame:
    """All rows; columns that a snapshot lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def history_keys(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.min("snapshot_date").alias("first_seen_at"), F.max("snapshot_date").alias("last_seen_at"), F.count("*").alias("times_seen"))


def with_lineage(rows: DataFrame, key: str = "id", *tiebreak: str) -> DataFrame:
    """Rows with first and last dates, times seen and ``recency`` (1 is the latest row of an id).

    Lineage and recency share one partitioning, so one shuffle makes both.
    """
    own = Window.partitionBy(key)
    order = own.orderBy(F.desc("snapshot_date"), *(tiebreak or (key,)))
    return rows.withColumns(
        {
            "first_seen_at": F.min("snapshot_date").over(own),
            "last_seen_at": F.max("snapshot_date").over(own),
            "times_seen": F.count("*").over(own),
            "recency": F.row_number().over(order),
        }
    )


def history(rows: DataFrame, key: str = "id", *tiebreak: str) -> DataFrame:
    """The latest row of every id, with lineage."""
    return with_lineage(rows, key, *tiebreak).where("recency = 1").drop("recency")


def active(rows: DataFrame, key: str = "id") -> DataFrame:
    """All rows of the latest snapshot, with lineage."""
    latest = rows.agg(F.max("snapshot_date").alias("latest"))
    own = Window.partitionBy(key)
    lineage = rows.withColumns({"first_seen_at": F.min("snapshot_date").over(own), "last_seen_at": F.max("snapshot_date").over(own), "times_seen": F.count("*").over(own)})
    # One row, at any size.
    return lineage.join(F.broadcast(latest), F.col("snapshot_date") == F.col("latest")).drop("latest")
