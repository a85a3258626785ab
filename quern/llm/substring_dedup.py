"""Repeated passages across documents, by seed and extend on winnowed anchors.

Seeds.  Of every ``WINDOW - ANCHOR + 1`` adjacent word ``ANCHOR``-grams the
smallest hash is an anchor (the first on ties), so each window of ``WINDOW``
words has one anchor inside it that its words alone determine: equal windows
have equal anchors at equal places.  Anchors that occur once cannot lie in a
repeat; the join of documents on anchors keeps those that occur again.

Extension.  An anchor is extended left and right over all windows that it is
the anchor of, up to ``WINDOW - ANCHOR`` words either way.  Extensions of one
anchor are matched by a hash of their words, for all partners at once and not
pair by pair, so a passage held by m documents costs m rows, not m * m.  Where an
anchor has extensions that differ, at the ends of repeats, the first document of
each is compared window by window with the others, so that a match is extended
just as far as it goes.  Matches that are adjacent in a document and in what they
match are joined: these are the maximal repeats, spans of at least ``WINDOW``
words with the place of the earliest occurrence.  Every word of a repeat goes.

Cost at scale.  About one word in seven is an anchor; a row of it is three longs
and three numbers.  Anchors are counted with map-side combining, then joined back
by an equi-join that adaptive execution splits for passages that many documents
hold.  Texts are shuffled twice, to the windows wanted of them and to the repeats
they lose, as neither has a size bound.  Each table is deleted once it has been read.

Defined results.  Null, empty and short texts have no window and stay whole.
Rows that share an id are one document for the order: equal starts in them are
not earlier than each other.  Rows without id take no part and stay whole.  The
kept text is the kept words joined by one space.  Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .words import Words, chunked_words, mix, spans_hash

WINDOW = 20
ANCHOR = 8


def anchors_of(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, place of each one's anchor, hashes of all anchor-grams) over a chunk of texts."""
    n = len(words.hashes)
    firsts = np.arange(max(0, n - anchor + 1))
    grams = spans_hash(words.hashes, firsts, firsts + anchor)
    span = window - anchor + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    low, place = grams[: n - window + 1].copy(), np.arange(n - window + 1)
    for i in range(1, span):
        other = grams[i : i + len(low)]
        less = other < low
        low[less] = other[less]
        place[less] = np.flatnonzero(less) + i
    lengths = np.diff(words.bounds)
    starts = np.arange(n - window + 1)
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = starts + window <= words.bounds[text[: len(starts)] + 1]
    return starts[inside], place[inside], grams


def joined(words: Words, kept: np.ndarray) -> pa.StringArray:
    """Kept words of each text, joined by one space."""
    starts, ends = words.starts[kept], words.ends[kept]
    cut = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    bounds = cut[np.concatenate([[0], np.cumsum(kept)])[words.bounds]]
    data = np.append(words.data, np.uint8(0x20))[np.repeat(starts - cut[:-1], np.diff(cut)) + np.arange(cut[-1])]
    data[cut[1:] - 1] = 0x20
    full = np.diff(bounds) > 0
    stay = np.ones(len(data), bool)
    stay[bounds[1:][full] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(np.diff(bounds) - full)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(full), pa.py_buffer(offsets), pa.py_buffer(data[stay].tobytes()))


_SECOND = np.uint64(0xA0761D6478BD642F)


def extensions(words: Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, hash of the anchor, hash of all words) of the extension of every anchor."""
    starts, places, grams = anchors_of(words, window, anchor)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (starts[1:] != starts[:-1] + 1) | (places[1:] != places[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(starts)))
    first = starts[head]
    return text[head], first, size, grams[places[head]], spans_hash(mix(words.hashes ^ _SECOND), first, first + size - 1 + window)


def _scan(window: int, anchor: int):
    """First pass: every anchor with its extension."""

    def run(batches):
        for batch in batches:
            for a, b, words in chunked_words(batch.column(1)):
                text, first, size, gram, whole = extensions(words, window, anchor)
                if not len(text):
                    continue
                columns = [pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64)), pa.array((first - words.bounds[text]).astype(np.int32)), pa.array(size.astype(np.int32))]
                found = pa.StructArray.from_arrays(columns, ["h", "k", "start", "m"])
                bounds = pa.array(np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(bounds, found)], ["id", "row", "found"])

    return run


def _flat(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(how many items each row has, the items' fields) of lists of structs; null lists are empty."""
    items = pc.list_flatten(column)
    count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return count, {f.name: items.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(items.type)}


def _windows(window: int):
    """Second pass: each window of the extensions that are wanted of a text, by two hashes."""

    def run(batches):
        for batch in batches:
            count, wanted = _flat(batch.column(3))
            cut = np.concatenate([[0], np.cumsum(count)])
            for a, b, words in chunked_words(batch.column(1)):
                size = wanted["m"][cut[a] : cut[b]].astype(np.int64)
                text = np.repeat(np.repeat(np.arange(b - a), count[a:b]), size)
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                place = np.repeat(wanted["start"][cut[a] : cut[b]], size) + inner
                at = words.bounds[text] + place
                hashes = [pa.array(spans_hash(h, at, at + window).view(np.int64)) for h in (words.hashes, mix(words.hashes ^ _SECOND))]
                yield pa.RecordBatch.from_arrays([*hashes, batch.column(0).take(pa.array(a + text)), batch.column(2).take(pa.array(a + text)), pa.array(place.astype(np.int32))], ["w1", "w2", "id", "row", "start"])

    return run


def _maximal(window: int):
    """Joins the matches of each document to maximal repeats: adjacent windows with adjacent sources."""

    def run(batches):
        for batch in batches:
            count, x = _flat(batch.column(2))
            doc = np.repeat(np.arange(len(count)), count)
            start, m, source = (x[name].astype(np.int64) for name in ("start", "m", "source_start"))
            order = np.lexsort((start, source - start, x["source_id"], doc))
            doc, start, m, source, source_id = doc[order], start[order], m[order], source[order], x["source_id"][order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (source_id[1:] != source_id[:-1]) | (source[1:] - start[1:] != source[:-1] - start[:-1]) | (start[1:] > start[:-1] + m[:-1])
            head = np.flatnonzero(fresh)
            last = np.append(head[1:], len(doc)) - 1
            length = start[last] + m[last] - 1 + window - start[head] if len(head) else start
            columns = [pa.array(start[head].astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(source_id[head]), pa.array(source[head].astype(np.int32))]
            spans = pa.StructArray.from_arrays(columns, ["start", "length", "source_id", "source_start"])
            bounds = pa.array(np.searchsorted(doc[head], np.arange(len(count) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(bounds, spans)], ["id", "row", "repeats"])

    return run


def _remove(batches):
    """Last pass: removed words and what is left."""
    for batch in batches:
        counts, spans = _flat(batch.column(2))
        cut = np.concatenate([[0], np.cumsum(counts)])
        for a, b, words in chunked_words(batch.column(1)):
            n = np.diff(words.bounds)
            first = np.repeat(words.bounds[:-1], counts[a:b]) + spans["start"][cut[a] : cut[b]]
            size = len(words.hashes) + 1
            steps = np.bincount(first, minlength=size) - np.bincount(first + spans["length"][cut[a] : cut[b]], minlength=size)
            covered = np.cumsum(steps)[:-1] > 0
            removed = np.concatenate([[0], np.cumsum(covered)])[words.bounds]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.diff(removed)), joined(words, ~covered)], ["doc_id", "n_words", "n_removed", "kept_text"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, row); ``row`` is a hash of the text, which tells rows of one id apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))


REPEATS = "repeats array<struct<start: int, length: int, source_id: long, source_start: int>>"


def _repeats(own: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, row, repeats): the maximal repeats of each text that has any, ``repeats`` as written table."""
    taking = own.where("id is not null")
    scanned = materialize(taking.select("id", "text", "row").mapInArrow(_scan(window, anchor), "id long, row long, found array<struct<h: long, k: long, start: int, m: int>>"), "anchors")
    again = scanned.select(F.explode("found.h").alias("h")).groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    # Counts are written before they are joined: only a join of two plain shuffles is split where a key is hot.
    again = materialize(again, "again")
    runs = materialize(scanned.select("id", "row", F.inline("found")).join(again, "h"), "runs")
    discard(scanned, again)

    extent = ["h", "k"]
    first = materialize(runs.groupBy(*extent).agg(F.min(F.struct("id", "start")).alias("f")), "firsts")
    kinds = materialize(first.groupBy("h").agg((F.count("*") > 1).alias("differs")), "kinds")
    first_known = first.join(kinds, "h").select(*extent, F.col("f.id").alias("source_id"), F.col("f.start").alias("source_start"), "differs")
    later = (F.col("id") > F.col("source_id")) | ((F.col("id") == F.col("source_id")) & (F.col("start") > F.col("source_start")))
    matched = runs.join(first_known, extent).withColumn("later", later).where("later or differs")
    matched = materialize(matched.select("id", "row", "start", "m", "later", "source_id", "source_start"), "matched")
    discard(runs, first, kinds)

    leads = matched.where("not later").groupBy("id", "row").agg(F.collect_set(F.struct("start", "m")).alias("wanted"))
    single = own.join(leads, ["id", "row"]).select("id", "text", "row", "wanted").mapInArrow(_windows(window), "w1 long, w2 long, id long, row long, start int")
    single = materialize(single, "windows")
    earliest = single.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("f"), F.count("*").alias("c")).where("c > 1")
    earliest = materialize(earliest.select("w1", "w2", F.col("f.id").alias("source_id"), F.col("f.start").alias("source_start")), "earliest")
    partly = single.join(earliest, ["w1", "w2"]).where(later).select("id", "row", "start", F.lit(1).alias("m"), "source_id", "source_start")

    pieces = matched.where("later").select("id", "row", "start", "m", "source_id", "source_start").union(partly)
    pieces = pieces.groupBy("id", "row").agg(F.collect_set(F.struct("start", "m", "source_id", "source_start")).alias("pieces"))
    repeats = materialize(pieces.mapInArrow(_maximal(window), f"id long, row long, {REPEATS}"), "repeats")
    discard(matched, single, earliest)
    return repeats


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, start, length, source_id, source_start) of every maximal repeat, in words; the source is the earliest place."""
    return _repeats(_texts(docs, id_col, text_col), window, anchor).select(F.col("id").alias("doc_id"), F.inline("repeats")).distinct()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per row of ``docs``.

    A word goes when a window of ``window`` words over it also starts earlier: in a
    smaller id, or earlier in the same document.  Windows are those of the input.
    """
    own = _texts(docs, id_col, text_col)
    decided = own.join(_repeats(own, window, anchor), ["id", "row"], "left")
    return decided.select("id", "text", "repeats").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
