"""Lines that occur in several documents, by levelled sorted runs of line hashes.

Documents are taken in batches by ascending id.  Each batch's line hashes are
anti-joined with the runs of all earlier batches: a hash found there belongs to
an earlier document, and its lines go.  Hashes that are new become a run of
their own, bucketed and sorted on disk, so that merging with it later neither
shuffles nor sorts it again.  When a level holds ``FANOUT`` runs they are
compacted into one run of the next level; a hash is rewritten once a level.

Cost at scale.  Texts are read twice and shuffled once; hashing happens in one
pass that writes (hash, id, place), partitioned by batch.  A line that a large
share of all documents hold is combined before the shuffle when owners are
found; the join that marks its lines is an equi-join that adaptive execution
splits.  Batches are ``BATCHES`` quantiles of the id, at any input size, and
``LineRuns`` takes further batches later.  Runs have as many buckets as the session
has shuffle partitions, so merging spreads as all other work does.

Defined results.  Null and empty texts are one empty line, which is too short
to be a key and stays.  Lines of an id that several rows share count as lines of
one document.  Rows without id take no part: all their lines stay.  Texts stay
whole otherwise, to the byte.  Only id and text columns are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exprs import SPACE_CHARS, fold, hash_pair
from .scratch import delete, discard, materialize, new_path

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without spaces at its ends, A-Z lower-cased."""
    return fold(F.btrim(line, F.lit(SPACE_CHARS)))


class LineRuns:
    """Sorted runs of the line hashes seen so far, by level."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "run")
        dealt = hashes.select(*HASH).repartition(self.buckets, *HASH)
        dealt.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.paths[name]).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def marked(self, keys: DataFrame) -> DataFrame:
        """``keys`` (unique hashes) with ``seen``: whether any run holds the hash."""
        seen = F.lit(False)
        for i, name in enumerate(self.runs()):
            keys = keys.join(self.spark.table(name).withColumn(f"in_{i}", F.lit(True)).hint("merge"), HASH, "left")
            seen = seen | F.col(f"in_{i}").isNotNull()
        return keys.withColumn("seen", seen).drop(*(f"in_{i}" for i in range(len(self.runs()))))

    def add(self, new: DataFrame) -> None:
        """Append hashes that no run holds, then compact every level that is full."""
        self._push(0, self._write(new))
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                union = self.spark.table(old[0])
                for name in old[1:]:
                    union = union.union(self.spark.table(name))
                self._push(level + 1, self._write(union))
                self._drop(old)
            level += 1

    def _push(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            delete(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Forget the runs and delete their files."""
        self._drop(self.runs())
        self.levels = []


def _batch_of(ids: Column, edges: list[int]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (ids > edge).cast("int")
    return out


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """(id, row, places) of the lines to drop from ``docs`` (id, text), after all that ``runs`` holds.

    ``row`` is a hash of the text, which tells rows of one id apart.
    """
    spark = docs.sparkSession
    own = runs is None
    runs = runs or LineRuns(spark)
    lines = docs.where("id is not null").select("id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    key = line_key(F.col("line"))
    h1, h2 = hash_pair(F.col("key"))
    keyed = lines.select("id", "row", "place", key.alias("key")).where(F.length("key") >= min_chars).select(h1.alias("h1"), h2.alias("h2"), "id", "row", "place")
    row = docs.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000).alias("edges")).first() if batches > 1 else None
    edges = sorted(set(row.edges or [])) if row else []
    keyed = materialize(keyed.withColumn("batch", _batch_of(F.col("id"), edges)), "lines", "batch")
    found = []
    try:
        for i in range(len(edges) + 1):
            batch = keyed.where(F.col("batch") == i).drop("batch")
            owners = batch.groupBy(*HASH).agg(F.min("id").alias("owner"), F.max("id").alias("last"))
            owners = materialize(runs.marked(owners), "owners")
            if i < len(edges) or not own:
                runs.add(owners.where(~F.col("seen")))
            shared = owners.where("seen or owner < last").select(*HASH, F.when(~F.col("seen"), F.col("owner")).alias("owner"))
            gone = batch.join(shared, HASH).where("owner is null or id > owner").select("id", "row", "place")
            found.append(materialize(gone, "gone"))
            discard(owners)
    finally:
        if own:
            runs.close()
    discard(keyed)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.groupBy("id", "row").agg(F.collect_set("place").alias("places"))


def _with_kept(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int, runs: LineRuns | None) -> DataFrame:
    """``docs`` with ``_quern_n`` (lines), ``_quern_rest`` (places that stay) and ``_quern_text`` (what they join to)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    gone = dropped_lines(own, min_chars, batches, runs).select(F.col("id").alias("_quern_id"), F.col("row").alias("_quern_row"), F.col("places").alias("_quern_places"))
    keyed = docs.withColumns({"_quern_key": F.col(id_col).cast("long"), "_quern_hash": F.xxhash64(text)})
    joined = keyed.join(gone, (F.col("_quern_key") == F.col("_quern_id")) & (F.col("_quern_hash") == F.col("_quern_row")), "left")
    joined = joined.withColumn("_quern_lines", F.split(text, "\n", -1)).withColumn("_quern_n", F.size("_quern_lines"))
    rest = F.array_except(F.sequence(F.lit(0), F.col("_quern_n") - 1), F.coalesce("_quern_places", F.array().cast("array<int>")))
    joined = joined.withColumn("_quern_rest", rest)
    kept = F.array_join(F.transform("_quern_rest", lambda i: F.get("_quern_lines", i)), "\n")
    return joined.withColumn("_quern_text", F.when(F.col("_quern_places").isNull(), text).otherwise(kept))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text), one row per row of ``docs``.

    A key held by several documents keeps its lines in the smallest id only.
    """
    done = _with_kept(docs.select(id_col, text_col), id_col, text_col, min_chars, batches, runs)
    n = F.col("_quern_n")
    return done.select(F.col(id_col).cast("long").alias("doc_id"), n.cast("long").alias("n_lines"), (n - F.size("_quern_rest")).cast("long").alias("n_dropped"), F.col("_quern_text").alias("kept_text"))


def strip_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` with the text column less its repeated lines; no row goes and other columns stay."""
    done = _with_kept(docs, id_col, text_col, min_chars, batches, runs)
    return done.withColumn(text_col, F.when(F.col("_quern_places").isNull(), F.col(text_col)).otherwise(F.col("_quern_text"))).select(*docs.columns)
