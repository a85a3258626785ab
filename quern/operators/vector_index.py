"""A stored inverted-list index of vectors: coarse cells, int8 codes a cell on disk, probed and reranked exactly.

Cells are the centres of a k-means over ``SAMPLE`` rows at most; every row is put in the cell of its nearest centre.
The table is partitioned by cell, and holds for each row its key, its code (components in 255 steps of the largest)
and its vector, so a search reads the codes of the cells that queries probe, and vectors of the same cells for the
candidates alone.  How many cells a query probes is measured when the index is built: as many as hold a share
``TUNED`` of the true neighbours of some of its own rows.

A cell may hold any share of the rows: rows of a cell are cut into blocks, queries of a cell into groups, and a task
scores a group against a block and returns ``REFINE * k`` rows a query.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stages
from .retrieval import top_k

SAMPLE, MOST_CELLS, ITERATIONS = 16_384, 1024, 12
TUNING_QUERIES, TUNING_K, TUNED = 64, 10, 0.96
BLOCK_ROWS, GROUP_ROWS, REFINE = 8192, 512, 6


def _matrix(column: pa.Array) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)


def fit_centres(x: np.ndarray, cells: int, seed: int = 17) -> np.ndarray:
    """k-means centres; a centre without rows moves to a row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(ITERATIONS):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=cells)
        sums = np.stack([np.bincount(own, x[:, j], cells) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), cells)])
    return centres.astype(np.float32)


def _coder(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)).astype(np.float64)
                scale = np.abs(x).max(1) / 127
                codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(x, centres).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), batch.column(0), batch.column(1)], ["cell", "code", "scale", "vector", "row"])

    return run


def _order_of_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Cells from the most promising one on, for each query: by inner product with the centre."""
    return np.argsort(-(x @ centres.T), 1, kind="stable")


def _tuned(rows: DataFrame, queries: np.ndarray, keys: list, centres: np.ndarray) -> int:
    """Cells to probe so that a share ``TUNED`` of the true neighbours of the queries lies in them: one scan, k rows a batch and query."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(1)).astype(np.float64), np.array(batch.column(0).to_pylist(), object)
            cells = _nearest(x, centres)
            for i, scores in enumerate(queries @ x.T):
                best = np.argsort(-scores, kind="stable")[: TUNING_K + 1]
                best = best[own[best] != keys[i]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i)), pa.array(cells[best].astype(np.int64)), pa.array(scores[best])], ["query", "cell", "score"])

    found = rows.mapInArrow(run, "query long, cell long, score double").withColumn("item", F.monotonically_increasing_id())
    best = top_k(found, "query", "item", "score", TUNING_K).select("query", "cell").collect()
    place = np.argsort(_order_of_cells(queries, centres), 1)
    depths = sorted(int(place[r.query, r.cell]) + 1 for r in best)
    return depths[min(len(depths) - 1, math.ceil(TUNED * len(depths)) - 1)] if depths else 1


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.meta = json.loads(stages.read_text(spark, f"{self.path}/index.json"))
        self.centres = np.array(self.meta["centres"], np.float32)

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str, vector: str, payload: list[str] | None = None, cells: int | None = None) -> VectorIndex:
        """Write the index of (key, vector, payload..) to ``path``; rows without key or vector are left out.  It counts once ``index.json`` is there."""
        spark, payload = rows.sparkSession, payload or []
        own = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"), F.struct(*payload).alias("row") if payload else F.lit(None).cast("int").alias("row"))
        sample = own.select("key", "vector").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()
        x = _matrix(sample["vector"].combine_chunks()).astype(np.float64) if sample.num_rows else np.zeros((1, 1))
        n = own.count() if cells is None else 0
        count = min(len(x), cells or max(1, min(MOST_CELLS, round(math.sqrt(n)))))
        centres = fit_centres(x, count)
        kind = own.schema["row"].dataType.simpleString()
        coded = own.select("vector", F.struct("key", "row").alias("row")).mapInArrow(_coder(centres), f"cell int, code binary, scale double, vector array<double>, row struct<key: {own.schema['key'].dataType.simpleString()}, row: {kind}>")
        flat = coded.select("cell", F.col("row.key").alias("key"), "code", "scale", "vector", *(F.col(f"row.row.{c}").alias(c) for c in payload))
        # A range of a cell's keys a task, so that a large cell is several files.
        flat.repartitionByRange("cell", F.xxhash64("key")).sortWithinPartitions("cell", "key").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        asked = x[:TUNING_QUERIES]
        probes = _tuned(own.select("key", "vector"), asked, sample["key"].to_pylist()[: len(asked)], centres) if sample.num_rows else 1
        meta = {"probes": probes, "key": key, "kind": own.schema["key"].dataType.simpleString(), "width": x.shape[1], "centres": centres.tolist()}
        stages.create_once(spark, f"{path}/index.json", json.dumps(meta))
        return cls(spark, path)

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def search(self, queries: DataFrame, query_id: str, vector: str, k: int = 10, where: Column | None = None, probes: int | None = None, own: bool = True) -> DataFrame:
        """(query, item, score, rank): the k best rows of the probed cells by inner product, scored on full vectors.

        ``where`` is over payload columns and is applied before anything is scored.  Without ``own``, an item of the query's key is no candidate.
        """
        probes, kind = probes or self.meta["probes"], dict(queries.dtypes)[query_id]
        asked = queries.where(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).alias("query"), F.col(vector).cast("array<double>").alias("q"))
        probed = asked.mapInArrow(_prober(self.centres, probes), f"query {kind}, q array<double>, cell int")
        # At most ``MOST_CELLS`` numbers; named in the plan, so that no other partition is even listed.
        cells = sorted(r.cell for r in probed.select("cell").distinct().collect())
        table = self.table() if len(cells) == len(self.centres) else self.table().where(F.col("cell").isin(cells))
        held = table if where is None else table.where(where)
        # Cells are few, and so are the rows of these two.
        sizes = held.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
        groups = probed.groupBy("cell").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("groups"))
        items = held.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        items = items.groupBy("cell", "block").agg(F.collect_list(F.struct("key", "code", "scale")).alias("items"))
        packs = probed.join(F.broadcast(groups), "cell").withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")))
        packs = packs.groupBy("cell", "group").agg(F.collect_list(F.struct("query", "q")).alias("queries"))
        rough = items.join(packs, "cell").select("cell", "items", "queries").mapInArrow(_scorer(REFINE * k, own), f"query {kind}, item {self.meta['kind']}, cell int, rough double")
        best = top_k(rough, "query", "item", "rough", REFINE * k).select("query", "item", "cell")
        vectors = table.select(F.col("cell"), F.col("key").alias("item"), "vector")
        exact = best.join(vectors, ["cell", "item"]).join(asked, "query")
        dot = F.aggregate(F.zip_with("q", "vector", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return top_k(exact.select("query", "item", dot.alias("score")), "query", "item", "score", k).withColumn("score", F.round("score", 4))


def _prober(centres: np.ndarray, probes: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cells = _order_of_cells(_matrix(batch.column(1)), centres)[:, :probes]
                rows = pa.array(np.repeat(np.arange(batch.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cells.ravel().astype(np.int32))], ["query", "q", "cell"])

    return run


def _scorer(keep: int, own: bool):
    """The best rows of a block for each query of a group, by codes."""

    def run(batches):
        for batch in batches:
            for cell, items, asked in zip(*(batch.column(i) for i in range(3)), strict=True):
                items, asked = items.values, asked.values
                keys, names = items.field("key"), asked.field("query")
                codes = np.frombuffer(b"".join(items.field("code").to_pylist()), np.int8).reshape(len(items), -1).astype(np.float32)
                scale = items.field("scale").to_numpy()
                queries = _matrix(asked.field("q")).astype(np.float32)
                place = np.array(keys.to_pylist(), object)
                for i, scores in enumerate((queries @ codes.T) * scale):
                    if not own:
                        scores[place == names[i].as_py()] = -np.inf
                    best = np.argpartition(-scores, keep - 1)[:keep] if len(scores) > keep else np.arange(len(scores))
                    best = best[scores[best] > -np.inf]
                    yield pa.RecordBatch.from_arrays([pa.array([names[i].as_py()] * len(best), names.type), keys.take(pa.array(best)), pa.array(np.full(len(best), cell.as_py(), np.int32)), pa.array(scores[best])], ["query", "item", "cell", "rough"])

    return run
