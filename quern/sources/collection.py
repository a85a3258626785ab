"""A keyed table of vectors in hash buckets, changed bucket by bucket.

``manifest-<version>.json`` names for each bucket the version of its data; the newest manifest is the
table.  An upsert rewrites the buckets that it has keys for, under a new version, and then
creates the next manifest, which can be created but not replaced: before that nothing has changed,
after that all of it has, and of two upserts at once the later one fails.  Buckets without new
keys are neither read nor written.  A deleted key stays as a row without vector until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stages

BUCKETS = 64
_DELETED = "_deleted"


@dataclass
class Upserted:
    """How many keys were there before, were new, went; how many buckets were rewritten, and how many left alone."""

    replaced: int
    added: int
    deleted: int
    touched: int
    untouched: int


def bucket_of(key: Column, buckets: int) -> Column:
    """A bucket from the first eight hex digits of the key's MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Collection:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, key: str, vector: str, dimensions: int, buckets: int = BUCKETS) -> Collection:
        """An empty collection; one that is there stays as it is."""
        made = cls(spark, path)
        if made._newest() is None:
            made._commit({"version": 0, "schema": schema, "key": key, "vector": vector, "dimensions": dimensions, "buckets": buckets, "data": {}})
        return made

    def _newest(self) -> dict | None:
        fs, where = stages.file_system(self.spark, self.path)
        if not fs.exists(where):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("manifest-"))
        return json.loads(stages.read_text(self.spark, f"{self.path}/{names[-1]}")) if names else None

    def manifest(self) -> dict:
        if (newest := self._newest()) is None:
            raise FileNotFoundError(f"no collection at {self.path}")
        return newest

    def _commit(self, manifest: dict) -> None:
        if not stages.create_once(self.spark, f"{self.path}/manifest-{manifest['version']:010d}.json", json.dumps(manifest)):
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        """Rows of some buckets, with deleted keys."""
        schema = f"{manifest['schema']}, {_DELETED} boolean"
        named = manifest["data"].items() if buckets is None else [(str(b), manifest["data"][str(b)]) for b in buckets if str(b) in manifest["data"]]
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in named]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._rows(self.manifest()).where(~F.col(_DELETED)).drop(_DELETED)

    def upsert(self, rows: DataFrame, deletes: DataFrame | None = None) -> Upserted:
        """Put ``rows`` in place of equal keys, and take the keys of ``deletes`` out; a key that is in both is deleted.

        Of rows that share a key the greatest is taken.  Null keys and vectors of another length are errors.
        """
        old = self.manifest()
        key, vector, buckets, columns = old["key"], old["vector"], old["buckets"], [f.name for f in self.spark.createDataFrame([], old["schema"]).schema]
        held = self.spark.createDataFrame([], old["schema"]).schema
        new = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in held), F.lit(False).alias(_DELETED))
        if deletes is not None:
            gone = deletes.select(*(F.col(key).cast(f.dataType).alias(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in held), F.lit(True).alias(_DELETED))
            new = new.unionByName(gone)
        one = F.max(F.struct(_DELETED, *(c for c in columns if c != key))).alias("_r")
        new = new.groupBy(key).agg(one).select(key, "_r.*").withColumn("_bucket", bucket_of(F.col(key), buckets))
        incoming = f"{self.path}/_incoming-{uuid.uuid4().hex}"
        new.write.partitionBy("_bucket").parquet(incoming)
        new = self.spark.read.schema(f"{old['schema']}, {_DELETED} boolean, _bucket int").parquet(incoming)
        try:
            wrong = F.count_if(F.col(key).isNull() | (~F.col(_DELETED) & (F.coalesce(F.size(vector), F.lit(-1)) != old["dimensions"])))
            # One row a bucket.
            seen = new.groupBy("_bucket").agg(wrong.alias("wrong")).collect()
            if any(r.wrong for r in seen):
                raise ValueError(f"{sum(r.wrong for r in seen)} rows without key, or with vectors of other than {old['dimensions']} dimensions")
            touched = sorted(r["_bucket"] for r in seen)
            before = self._rows(old, touched).select(*columns, _DELETED)
            known = before.select(F.col(key).alias("_k"), (~F.col(_DELETED)).alias("_live"))
            matched = new.join(known, F.col(key) == F.col("_k"), "left").select(_DELETED, F.coalesce("_live", F.lit(False)).alias("was"))
            counts = matched.agg(F.count_if(~F.col(_DELETED) & F.col("was")).alias("replaced"), F.count_if(~F.col(_DELETED) & ~F.col("was")).alias("added"), F.count_if(F.col(_DELETED) & F.col("was")).alias("deleted")).first()
            folder = f"data/v-{old['version'] + 1:010d}-{uuid.uuid4().hex}"
            left = before.join(new.select(key), key, "left_anti").withColumn("_bucket", bucket_of(F.col(key), buckets))
            merged = left.unionByName(new)
            # By bucket and a range of the key's hash, so that a bucket may be several files.
            merged.repartitionByRange("_bucket", F.xxhash64(key)).sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            self._commit(old | {"version": old["version"] + 1, "data": old["data"] | {str(b): folder for b in touched}})
        finally:
            stages.delete(self.spark, incoming)
        return Upserted(counts.replaced, counts.added, counts.deleted, len(touched), buckets - len(touched))

    def vacuum(self) -> int:
        """Delete what the newest manifest does not name: older manifests, their data, what failed upserts left.  How many folders went."""
        now = self.manifest()
        keep, removed = {f.split("/", 1)[1] for f in now["data"].values()}, 0
        for parent, wanted in ((f"{self.path}/data", keep), (self.path, None)):
            fs, where = stages.file_system(self.spark, parent)
            if not fs.exists(where):
                continue
            for status in fs.listStatus(where):
                name = status.getPath().getName()
                stale = name not in wanted if wanted is not None else name.startswith("_incoming-") or (name.startswith("manifest-") and name != f"manifest-{now['version']:010d}.json")
                if stale:
                    fs.delete(status.getPath(), True)
                    removed += 1
        return removed
