"""Near-duplicate documents by min-max hashing.

Under each permutation both the smallest and the largest value of a document's
shingle set are kept, so P permutations give 2P signature values for the price
of P evaluations; either value agrees between two sets with a chance equal to
their Jaccard similarity.  Values are banded; documents that share a band are
candidates, and every link is confirmed on the full sets.

Cost at scale.  Equal sets are folded into one node first (map-side combined),
so copies cost one row each and no pairs.  Nodes of a bucket, and of two adjacent
bands in common, are first tied to the first node there: at most a row a node and
band.  Only nodes that this leaves in another component than their bucket's main
one are compared further, with the nodes of other components in their buckets,
and only where sizes and 2048-bit sketches (one bit of each value of a longer
min-max signature, made for bucket mates alone) allow the threshold; these are
join conditions, so rejected pairs are never rows, and a pair is one row however
many buckets it shares.  Nothing is capped: a pair in
a common bucket is in one component already, or compared, or ruled out by size
(exact) or by sketch (over 4 standard deviations).  With the defaults a pair at
similarity 0.8 shares no band, or fails the sketch, once in 5 * 10**4, and once in
2.5 * 10**4 if its sets are small (for 4 of 5 shingles minimum and maximum are not
independent: both agree with 0.6, not 0.64); a more similar pair far less often.

Defined results.  Null, empty or blank texts have an empty set, link with
nothing and are kept.  Fewer words than a shingle: the whole sequence is the one
shingle.  Rows that share an id are one node: a link of either text is a link of
the id.  A row without id takes no part, has no component and is kept.
``keep_one_of_each`` works on texts instead, so a text goes only if a near copy of
it, or of a near copy, stays; of rows with equal id and text one stays.
Columns other than id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exprs import WORD
from .scratch import discard, materialize
from .words import Words, chunked_words, mix, spans_hash

PERMUTATIONS = 126
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
SKETCH_PERMUTATIONS = 1024
SKETCH_LONGS = 2 * SKETCH_PERMUTATIONS // 64

_RNG = np.random.default_rng(97)
_A = _RNG.integers(0, 2**32, SKETCH_PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, SKETCH_PERMUTATIONS, dtype=np.uint32)
_BAND_WEIGHTS = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND_SALTS = _RNG.integers(0, 2**64, BANDS, dtype=np.uint64)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    n = len(words.hashes)
    first = np.arange(max(0, n - k + 1))
    grams = spans_hash(words.hashes, first, first + k)
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield spans_hash(words.hashes[a:b], np.array([0]), np.array([b - a]))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, permutations: int = PERMUTATIONS, block: int = 1 << 19) -> np.ndarray:
    """Two values a permutation, minimum and maximum in turn."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(permutations, 2**32 - 1, np.uint32), np.zeros(permutations, np.uint32)
    step = max(1, block // permutations)
    for i in range(0, len(x), step):
        values = _A[:permutations, None] * x[None, i : i + step]
        values += _B[:permutations, None]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).ravel()


def sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit of each value of a long signature, as longs."""
    bits = (signature(shingles, SKETCH_PERMUTATIONS) * np.uint32(2654435761)) >> np.uint32(31)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def sketch_slack(percent: int, deviations: float = 4.2) -> int:
    """Differing bits that a pair at the threshold stays within."""
    bits, differ = 64 * SKETCH_LONGS, (100 - percent) / 200
    return int(np.ceil(bits * differ + deviations * np.sqrt(bits * differ * (1 - differ))))


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            ids, counts, sums, keys = batch.column(0), [], [], []
            for _, _, words in chunked_words(batch.column(1), fold=True):
                for s in shingle_sets(words, k):
                    counts.append(len(s))
                    sums.append((mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(s + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)))
                    if len(s):
                        values = signature(s)
                        rows = values.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
                        keys.append(mix((mix(rows) * _BAND_WEIGHTS).sum(1, dtype=np.uint64) + _BAND_SALTS).view(np.int64))
            full = np.array(counts, np.int64) > 0
            lists = lambda parts, each: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * each)]).astype(np.int32)), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
            f = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(f[:, 0].copy()), pa.array(f[:, 1].copy()), lists(keys, BANDS)],
                ["id", "n", "f1", "f2", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for a, b, words in chunked_words(batch.column(1), fold=True):
                sets = [s.view(np.int64) for s in shingle_sets(words, k)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                bits = [sketch(s.view(np.uint64)) for s in sets]
                lists = [pa.ListArray.from_arrays(pa.array(x), pa.array(np.concatenate(y))) for x, y in ((ends, sets), (np.arange(len(sets) + 1, dtype=np.int32) * SKETCH_LONGS, bits))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], ["id", "shingles", "sketch"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    total = F.size("sa").cast("long") + F.size("sb")
    return pairs.join(left, "a").join(right, "b").where(both * (100 + percent) >= total * percent).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Links: 100 * intersection >= percent * union over sets of ``shingle_words``-word
    shingles of lower-cased (A-Z) words.  ``component_id`` is the smallest id that
    can be reached over links; ``kept`` marks that document.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = base.mapInArrow(_signatures(shingle_words), "id long, n long, f1 long, f2 long, bands array<long>")
    sig = materialize(sig, "minmax")

    taking = sig.where("n > 0 and id is not null")
    folded = taking.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"))
    # An id that owns several sets ties together the nodes that these were folded into.
    several = sig.where("id is not null").groupBy("id").agg((F.min("f1") != F.max("f1")).alias("several")).where("several").select("id")
    owned = taking.select("id", "f1", "f2", "n").join(several, "id").join(folded.withColumnRenamed("id", "rep"), ["f1", "f2", "n"]).where("id <> rep")
    owned = materialize(owned.select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct(), "owned")
    nodes = materialize(taking.join(folded, ["f1", "f2", "n", "id"], "left_semi").dropDuplicates(["f1", "f2", "n"]), "nodes")

    bands = nodes.select("id", "n", "bands", F.posexplode("bands").alias("i", "key"))
    rows = bands.select("id", "n", "key", F.xxhash64("key", F.get("bands", F.pmod(F.col("i") + 1, F.lit(BANDS)))).alias("fine"))
    shared = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("key", "rep")
    hits = materialize(rows.join(shared, "key"), "hits")

    wanted = hits.select("id").distinct()
    sets = base.join(wanted, "id", "left_semi").mapInArrow(_sets(shingle_words), "id long, shingles array<long>, sketch array<long>")
    sets = materialize(sets, "sets")

    # Ties: with the first node of the buckets that a node shares most often, and with the first of each pair of adjacent bands.
    most = hits.where("id <> rep").groupBy("id", "rep").agg(F.count("*").alias("c"))
    most = most.groupBy("id").agg(F.max_by("rep", F.struct("c", -F.col("rep"))).alias("rep"))
    finest = hits.groupBy("fine").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").select("fine", "first")
    finest = hits.join(finest, "fine").where("id <> first").select("id", F.col("first").alias("rep"))
    ties = most.union(finest).distinct().select(F.col("id").alias("a"), F.col("rep").alias("b"))
    tied = materialize(_confirmed(ties, sets, percent), "tied")
    labels = components(tied.union(owned), "a", "b")

    # What is left: nodes outside the main component of a bucket, against the other components there.
    known = labels.withColumnRenamed("vertex", "id")
    placed = hits.select("key", "id", "n").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", -F.col("component"))).alias("main"), F.count("*").alias("k")).where("k > 1").select("key", "main")
    mixed = placed.join(main, "key").join(sets.select("id", F.size("shingles").cast("long").alias("n"), "sketch"), ["id", "n"]).join(nodes.select("id", "n", "bands"), ["id", "n"])
    mixed = materialize(mixed, "mixed")
    one = mixed.where("component <> main").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("sketch").alias("ka"), F.col("bands").alias("ba"))
    two = mixed.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("sketch").alias("kb"), F.col("bands").alias("bb"), (F.col("component") == F.col("main")).alias("in_main"))
    differing = sum(F.bit_count(F.get("ka", F.lit(i)).bitwiseXOR(F.get("kb", F.lit(i)))) for i in range(SKETCH_LONGS))
    fits = (
        (F.col("ca") != F.col("cb"))
        & (F.col("in_main") | (F.col("a") < F.col("b")))
        & (F.col("na") * 100 >= F.col("nb") * percent)
        & (F.col("nb") * 100 >= F.col("na") * percent)
        & (differing <= sketch_slack(percent))
        & (one["key"] == F.array_min(F.array_intersect("ba", "bb")))
    )
    rest = one.join(two, (one["key"] == two["key"]) & fits).select("a", "b").distinct()
    found = materialize(_confirmed(rest, sets, percent), "found")
    discard(hits, sets, tied, mixed)
    if not found.isEmpty():
        labels = components(found.union(labels.select(F.col("vertex").alias("a"), F.col("component").alias("b"))), "a", "b")

    groups = nodes.select("f1", "f2", "n", F.col("id").alias("rep"))
    out = sig.select("id", "n", "f1", "f2").join(groups, ["f1", "f2", "n"], "left").withColumn("vertex", F.coalesce("rep", "id"))
    out = out.join(labels, "vertex", "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "vertex")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each near-duplicate group of texts, that of the smallest id, with all its columns.

    Rows without id or without words all stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = ["_quern_id", "_quern_key", "_quern_check"]
    marked = docs.withColumns(dict(zip(names, (F.col(id_col).cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)))
    takes = F.col("_quern_id").isNotNull() & text.rlike(WORD)
    texts = marked.where(takes)
    groups = near_duplicates(texts.select("_quern_key", text.alias("_quern_text")), "_quern_key", "_quern_text", shingle_words, percent)
    groups = groups.select(F.col("doc_id").alias("_quern_key"), "component_id").distinct()
    rows = texts.select(*names).distinct()
    best = rows.join(groups, "_quern_key").groupBy("component_id").agg(F.min(F.struct("_quern_id", "_quern_key")).alias("best")).select("best.*")
    # Different texts of one key (a collision of the hash) all stay.
    unsure = rows.groupBy("_quern_key").agg((F.min("_quern_check") != F.max("_quern_check")).alias("unsure")).where("unsure")
    best = best.union(rows.join(unsure, "_quern_key").select("_quern_id", "_quern_key"))
    one_each = texts.dropDuplicates(names).join(best, ["_quern_id", "_quern_key"], "left_semi")
    return one_each.select(*docs.columns).union(marked.where(~takes).select(*docs.columns))
