"""Ranked lexical search over a bit-sliced impact index.

Documents are numbered within blocks of at most ``BLOCK`` in the order of their ids.  A
block's index has for each term the documents that hold it and how often; its impact
on a document's score is a whole number, and bit i of all impacts in the block is one
bitmap, slice i.  A query adds the slices of its terms by bitwise carry arithmetic, all
documents of a block at once (a repeated term is added once a bit of its count, shifted),
and finds its top k from the most significant slice downwards: documents in the slice are
ahead of the others as long as no more than k are, and at last equal scores go to
the lower numbers, which are the lower ids.  Bitmaps are Python integers.

Cost at scale.  Texts are tokenised once, in the scan's own partitions; the postings of a
block are written without a shuffle, one row a block and term.  Counts of
documents by term come from those rows, not from postings.  Queries are packed in groups of
``GROUP``; each group reads the postings of its own terms, and a block meets a group in one
row.  A frequent term is cut by blocks like any other.  A block returns k rows
a query, however many tie.  Nothing but one block and group is ever in one place.

Defined results.  Null texts have no term; documents and items without one neither rank
nor ask, and documents without one do not count.  Items that share id and text are one
item; items that share the id alone each have ranks of their own.  Rows that share a
doc_id are documents of their own; a null doc_id comes after all others among equal scores.
An empty table of either kind gives no rows.  Only ids and texts are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import LOWER, UPPER
from .scratch import materialize

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK, BLOCK_POSTINGS, GROUP = 1 << 14, 1 << 20, 256
LENGTH_PERCENT, SATURATION, ONE, WEIGHT_SCALE = 25, 12, 1_000_000_000, 1000

_POSTINGS = "block long, term string, documents binary, counts binary, n_documents long, ids array<long>, lengths binary, n_terms long"
_FOLD = str.maketrans(UPPER, LOWER)


def terms_of(text: str | None, pattern: re.Pattern[str]) -> list[str]:
    return pattern.findall((text or "").translate(_FOLD))


def _posted(block_rows: int, block_postings: int):
    """Postings of each block, one row a term, and one row (without term) of the block's ids and lengths."""

    def pack(number: int, held: list[tuple[int | None, Counter]]) -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        places: dict[str, tuple[list[int], list[int]]] = {}
        for place, (_, counted) in enumerate(held):
            for term, count in counted.items():
                at, counts = places.setdefault(term, ([], []))
                at.append(place)
                counts.append(count)
        lengths = np.array([c.total() for _, c in held], np.int64)
        n = len(places)
        columns = [[number] * (n + 1), [*places, None], [np.array(a, np.uint32).tobytes() for a, _ in places.values()] + [None], [np.array(c, np.uint32).tobytes() for _, c in places.values()] + [None]]
        columns += [[len(a) for a, _ in places.values()] + [len(held)], [None] * n + [[d for d, _ in held]], [None] * n + [lengths.tobytes()], [None] * n + [int(lengths.sum())]]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "term", "documents", "counts", "n_documents", "ids", "lengths", "n_terms"])

    def run(batches):
        pattern, held, postings = re.compile(TERM), [], 0
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                counted = Counter(terms_of(text.as_py(), pattern))
                if not counted:
                    continue
                held.append((doc.as_py(), counted))
                postings += len(counted)
                if len(held) >= block_rows or postings >= block_postings:
                    yield pack(number, held)
                    number, held, postings = number + 1, [], 0
        if held:
            yield pack(number, held)

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Written postings of all terms of all texts, block by block; one row without term holds a block's ids and lengths."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(base.mapInArrow(_posted(block_rows, block_postings), _POSTINGS), "postings")


def impacts(weight: int, counts: np.ndarray, lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """Impact of a term on each of its documents: w * ((10**9 * tf) div (1000 * tf + 12 * m))."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * lengths * n) // total
    return weight * ((ONE * counts) // (WEIGHT_SCALE * counts + SATURATION * m))


def slices_of(places: np.ndarray, values: np.ndarray, size: int) -> list[int]:
    """Bitmaps of the values' bits, lowest bit first; bit p of a map stands for document p."""
    bits = int(values.max(initial=0)).bit_length()
    plane = np.zeros((bits, size), np.uint8)
    plane[:, places] = (values[None, :] >> np.arange(bits)[:, None]) & 1
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(plane, 1, bitorder="little")]


def add(total: list[int], more: list[int], shift: int = 0) -> None:
    """total += more << shift for all documents at once, by full adders over slices."""
    total.extend([0] * (len(more) + shift - len(total)))
    carry = 0
    for i, b in enumerate(more, shift):
        a = total[i]
        half = a ^ b
        total[i] = half ^ carry
        carry = (a & b) | (half & carry)
    i = shift + len(more)
    while carry:
        if i == len(total):
            total.append(0)
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def top(total: list[int], k: int) -> list[tuple[int, int]]:
    """(place, score) of the k highest scores above 0, from the most significant slice down; equal scores by place."""
    ahead, tied = 0, 0
    for bitmap in total:
        tied |= bitmap
    for bitmap in reversed(total):
        some = ahead | (tied & bitmap)
        n = some.bit_count()
        if n > k:
            tied &= bitmap
        else:
            ahead, tied = some, tied & ~bitmap
            if n == k:
                tied = 0
                break
    places = list(_members(ahead))
    for place in _members(tied):
        if len(places) == k:
            break
        places.append(place)
    scored = [(p, sum((bitmap >> p & 1) << i for i, bitmap in enumerate(total))) for p in places]
    return sorted(scored, key=lambda s: (-s[1], s[0]))


def _members(bitmap: int) -> Iterable[int]:
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def _answers(n: int, total: int, k: int):
    """The best k documents of a block for each item of a group."""

    def run(batches):
        for batch in batches:
            for ids, lengths, terms, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids, lengths = ids.as_py(), np.frombuffer(lengths.as_py(), np.int64)
                sliced: dict[str, list[int]] = {}
                for t in terms.as_py():
                    places, counts = np.frombuffer(t["documents"], np.uint32), np.frombuffer(t["counts"], np.uint32).astype(np.int64)
                    sliced[t["term"]] = slices_of(places, impacts(t["weight"], counts, lengths[places], n, total), len(ids))
                rows = []
                for item in asked.as_py():
                    score: list[int] = []
                    for term, times in zip(item["terms"], item["times"], strict=True):
                        for shift in range(times.bit_length()):
                            if times >> shift & 1 and term in sliced:
                                add(score, sliced[term], shift)
                    rows += [(item["item"], ids[place], value) for place, value in top(score, k)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item", "doc_id", "score"])

    return run


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each item, best first."""
    asked = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    # Numbered once and written: what is written does not change when a task is run again.
    asked = materialize(asked.select(F.monotonically_increasing_id().alias("item"), "item_id", _terms(F.col("text")).alias("terms")), "items")
    stats = index.where("term is null").agg(F.sum("n_documents").alias("n"), F.sum("n_terms").alias("total"), F.count("*").alias("blocks")).first()
    groups = max(1, -(-asked.count() // group))
    one = asked.select("item", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("group"), F.explode("terms").alias("term"))
    one = materialize(one.groupBy("group", "item", "term").agg(F.count("*").alias("times")), "asked")
    if not stats.blocks:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    wanted = one.select("group", "term").distinct()
    # A term has one row a block here, so the counts are of few rows, combined before they move.
    held = index.where("term is not null")
    frequency = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n_documents").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT_SCALE)) * F.log((2.0 * stats.n + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    weights = materialize(wanted.join(frequency, "term").select("group", "term", weight.alias("weight")).where("weight > 0"), "weights")
    postings = held.select("block", "term", "documents", "counts").join(weights, "term")
    postings = postings.groupBy("block", "group").agg(F.collect_list(F.struct("term", "weight", "documents", "counts")).alias("found"))
    packed = one.groupBy("group", "item").agg(F.collect_list("term").alias("terms"), F.collect_list("times").alias("times"))
    packed = packed.groupBy("group").agg(F.collect_list(F.struct("item", "terms", "times")).alias("asked"))
    blocks = index.where("term is null").select("block", "ids", "lengths")
    cells = postings.join(blocks, "block").join(packed, "group").select("ids", "lengths", "found", "asked")
    best = cells.mapInArrow(_answers(stats.n, stats.total, k), "item long, doc_id long, score long")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
