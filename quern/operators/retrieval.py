"""Batch retrieval over a table of queries: chunk, embed, score, fuse, rerank, hydrate, evaluate."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lets import unnested
from ..sources import stages
from .sampling import sample_n

# Sizes, separators and constants of retrieval.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ")
PARENT_CHARS, CHILD_CHARS, CHILD_OVERLAP = 4096, 1024, 128
RRF_K, FIRST_PASS, RERANKED = 60, 100, 20
#: Queries and (item, term) entries that meet in one task.
SPARSE_QUERIES, SPARSE_ENTRIES = 512, 1_000_000
BM25_K1, BM25_B = 1.2, 0.75
TERM = r"[\p{L}\p{N}]+"


# --- chunking ---------------------------------------------------------------------------


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: at the first separator that occurs, finer ones inside what is too long, and neighbours merged again."""
    here = next((i for i, s in enumerate(separators) if s in text), None)
    if here is None:
        step = max(1, size - overlap)
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), step)] if len(text) > size else [text] * bool(text.strip())
    mark, finer = separators[here], separators[here + 1 :]
    parts = text.split(mark)
    parts = [parts[0], *(mark + p for p in parts[1:])]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        piece = "".join(held).strip()
        if piece:
            out.append(piece)

    for part in parts:
        if len(part) > size:
            flush()
            held.clear()
            out.extend(split_text(part, size, overlap, finer))
            continue
        if held and sum(map(len, held)) + len(part) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(part) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def splitter(size: int, overlap: int):
    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return text.map(lambda t: split_text(t or "", size, overlap))

    return split


def fixed_width(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters by position alone."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def chunk(docs: DataFrame, key: str, title: str, body: str, parent: Callable[[Column], Column] | None = None, child: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, parent_chunk_id, child_chunk_id, parent_text, child_text); children count on across parents."""
    parent = parent or splitter(PARENT_CHARS, 0)
    child = child or splitter(CHILD_CHARS, CHILD_OVERLAP)
    text = F.concat(F.lit("# "), F.coalesce(F.col(title), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")))
    whole = docs.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").select(key, text.alias("_t"))
    parents = whole.select(key, F.posexplode(parent(F.col("_t"))).alias("p", "parent_text"))
    # Parents are put in order with their children in one row each: children's rows would carry their parent's text along.
    before = F.coalesce(F.sum(F.size("_own")).over(Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parents.withColumn("_own", child(F.col("parent_text"))).withColumn("_before", before)
    children = placed.select(key, "p", "parent_text", "_before", F.posexplode_outer("_own").alias("i", "child_text")).where("i is not null")
    number = F.col("_before") + F.col("i")
    return children.select(key, F.concat(F.col(key).cast("string"), F.lit("::p"), "p").alias("parent_chunk_id"), F.concat(F.col(key).cast("string"), F.lit("::c"), F.format_string("%04d", number)).alias("child_chunk_id"), "parent_text", "child_text")


def _nested(text: Column) -> Column:
    """Parents with their children as array<struct<parent_text, own>>, both by the splitter."""

    @F.arrow_udf("array<struct<parent_text: string, own: array<string>>>")
    def split(column: pa.Array) -> pa.Array:
        out = [[{"parent_text": p, "own": split_text(p, CHILD_CHARS, CHILD_OVERLAP)} for p in split_text(t or "", PARENT_CHARS, 0)] for t in column.to_pylist()]
        return pa.array(out, pa.list_(pa.struct([("parent_text", pa.string()), ("own", pa.list_(pa.string()))])))

    return split(text)


def chunk_in_place(docs: DataFrame, key: str, title: str, body: str, parent: Callable[[Column], Column] | None = None, child: Callable[[Column], Column] | None = None) -> DataFrame:
    """``chunk`` with no text leaving its row: a document's children are numbered in the list that they are cut into.

    ``parent`` and ``child`` are built-in expressions, given both or neither.  Where a key occurs twice its children count on
    from row to row, which takes ``chunk``.
    """
    if docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return chunk(docs, key, title, body, parent, child)
    text = F.concat(F.lit("# "), F.coalesce(F.col(title), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(body), F.lit("")))
    whole = docs.where(F.trim(F.coalesce(F.col(body), F.lit(""))) != "").select(key, text.alias("_t"))
    cut = _nested(F.col("_t")) if parent is None else F.transform(parent(F.col("_t")), lambda p: F.struct(p.alias("parent_text"), child(p).alias("own")))
    of = lambda p, i: F.transform(p["own"], lambda c: F.struct(i.alias("p"), p["parent_text"].alias("parent_text"), c.alias("child_text")))
    pieces = whole.select(key, cut.alias("_cut")).select(key, F.posexplode_outer(F.flatten(F.transform("_cut", of))).alias("_n", "_piece")).where("_n is not null")
    name = F.col(key).cast("string")
    return pieces.select(key, F.concat(name, F.lit("::p"), "_piece.p").alias("parent_chunk_id"), F.concat(name, F.lit("::c"), F.format_string("%04d", F.col("_n"))).alias("child_chunk_id"), "_piece.parent_text", "_piece.child_text")


# --- vectors ----------------------------------------------------------------------------


def hashing_embedder(dimensions: int = 256):
    """A pluggable default: signed hashed words, of length 1; a text without words is all zero."""

    @F.pandas_udf("array<float>")
    def embed(text: pd.Series) -> pd.Series:
        words = text.fillna("").str.lower().str.split()
        row = np.repeat(np.arange(len(text)), words.str.len())
        flat = np.array([w for own in words for w in own], dtype=object)
        hashes = pd.util.hash_array(flat) if len(flat) else np.zeros(0, np.uint64)
        sign = np.where((hashes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        out = np.bincount(row * dimensions + (hashes % np.uint64(dimensions)).astype(np.int64), sign, len(text) * dimensions).reshape(len(text), dimensions)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list((out / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return embed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def renormalized(vector: Column, tolerance: float = 1e-2) -> Column:
    norm = F.sqrt(dot(vector, vector))
    return F.when((F.abs(norm - 1) > tolerance) & (norm > 0), F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector)


def max_sim(query: Column, passage: Column) -> Column:
    """Late interaction: the best passage token of each query token, summed."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(passage, lambda p: dot(q, p)))), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """The k best items a query, with ``rank`` from 1; ties to the smaller item."""
    order = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _packed(rows: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of about ``size`` keys and vectors each, as lists."""
    # Keys alone are counted: vectors may have to be made.
    blocks = max(1, -(-rows.where(F.col(key).isNotNull()).select(key).count() // size))
    own = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    dealt = own.withColumn("_block", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    # No filter on the vector, which would have it made a second time: keys without one are left out here.
    keys = F.collect_list(F.when(F.col("v").isNotNull(), F.col("k")))
    packed = dealt.groupBy("_block").agg(keys.alias(f"{name}_keys"), F.flatten(F.collect_list("v")).alias(f"{name}_values"), F.max(F.size("v")).alias(f"{name}_width"))
    return packed.where(F.size(f"{name}_keys") > 0).drop("_block")


def _block_scorer(k: int, own: bool):
    """The k best items of each query of a block of queries among a block of items; ties to the smaller item."""

    def run(batches):
        for batch in batches:
            for q_keys, q_values, q_width, keys, values, width in zip(*(batch.column(i) for i in range(6)), strict=True):
                names, items = np.array(q_keys.as_py()), np.array(keys.as_py())
                queries = q_values.values.to_numpy(zero_copy_only=False).reshape(len(names), q_width.as_py())
                vectors = values.values.to_numpy(zero_copy_only=False).reshape(len(items), width.as_py())
                order = np.argsort(items, kind="stable")
                items, vectors = items[order], vectors[order]
                out = []
                for name, query, row in zip(names, queries, queries @ vectors.T, strict=True):
                    if not own:
                        row[items == name] = -np.inf
                    keep = min(k, len(row))
                    least = np.partition(row, len(row) - keep)[len(row) - keep]
                    # Products of the near ones are summed again in one order, so that equal vectors score alike.
                    near = np.flatnonzero((row >= least - 1e-9 * (1 + abs(least))) & (row > -np.inf))
                    scores = np.zeros(len(near))
                    for d in range(len(query)):
                        scores += query[d] * vectors[near, d]
                    best = np.argsort(-scores, kind="stable")[:keep]
                    out.append((np.repeat(name, len(best)), items[near[best]], scores[best]))
                if out:
                    kinds = (q_keys.type.value_type, keys.type.value_type, pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)).cast(kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["query", "item", "score"])

    return run


def dense_top_k(queries: DataFrame, items: DataFrame, query_id: str, query_vector: str, item_id: str, item_vector: str, k: int = FIRST_PASS, where: Column | None = None, own: bool = True, query_rows: int = 1024, item_rows: int = 16_384) -> DataFrame:
    """(query, item, score, rank): exact top k by dot product; items are filtered before they are scored.

    Queries and items are packed in blocks; a task scores one block of queries against
    one block of items and returns k rows a query, so no pair is ever a row.  Without
    ``own`` an item of the query's own id is no candidate.  Ranks go by the full score.
    """
    pool = items if where is None else items.where(where)
    asked, held = _packed(queries, query_id, query_vector, query_rows, "q"), _packed(pool, item_id, item_vector, item_rows, "i")
    cells = asked.crossJoin(held).select("q_keys", "q_values", "q_width", "i_keys", "i_values", "i_width")
    kinds = dict(queries.dtypes)[query_id], dict(items.dtypes)[item_id]
    scored = cells.mapInArrow(_block_scorer(k, own), f"query {kinds[0]}, item {kinds[1]}, score double")
    return top_k(scored, "query", "item", "score", k).withColumn("score", F.round("score", 4))


# --- words ------------------------------------------------------------------------------


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return unnested(df, _words(text), "term", key).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def bm25_weights(docs: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> DataFrame:
    """(key, term, weight): the sparse vector of each document; of the terms in ``asked`` (term) alone, if there are such.

    Other terms count for the lengths then, but are no rows.
    """
    if asked is None:
        return weights_of(terms(docs, key, text), key)
    lengths = docs.select(key, F.size(_words(text)).alias("n")).groupBy(key).agg(F.sum("n").alias("dl")).where("dl > 0")
    own = unnested(docs, _words(text), "term", key).join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
    return weights_of(own.groupBy(key, "term").agg(F.count("*").alias("tf")), key, lengths)


def weights_of(tf: DataFrame, key: str, lengths: DataFrame | None = None) -> DataFrame:
    """``bm25_weights`` of (key, term, tf), which four branches read: a stored table is read, anything else made again."""
    lengths = tf.groupBy(key).agg(F.sum("tf").alias("dl")) if lengths is None else lengths
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
    return tf.join(df, "term").join(lengths, key).join(F.broadcast(corpus)).select(key, "term", weight.alias("weight"))


def _sparse_scorer(k: int):
    """The k best items of each query of a pack among a pack of items, from lists of (query, term) and of (item, term, weight)."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q_names, q_terms, items, terms_, weights = (batch.column(i)[row].values for i in range(5))
                own = items.dictionary_encode()
                order = pc.sort_indices(own.dictionary).to_numpy()
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                names = own.dictionary.take(pa.array(order))
                words = terms_.dictionary_encode()
                by_term = np.argsort(words.indices.to_numpy(), kind="stable")
                code = words.indices.to_numpy()[by_term]
                at, w = place[own.indices.to_numpy()][by_term], weights.to_numpy()[by_term]
                starts = np.searchsorted(code, np.arange(len(words.dictionary) + 1))
                asking = q_names.dictionary_encode()
                wanted = pc.index_in(q_terms, value_set=words.dictionary).to_numpy(zero_copy_only=False)
                out = []
                for q in range(len(asking.dictionary)):
                    mine = wanted[asking.indices.to_numpy() == q]
                    # Sums of one order, whatever order the lists came in.
                    spans = [slice(starts[int(t)], starts[int(t) + 1]) for t in np.sort(mine[~np.isnan(mine.astype(np.float64))])]
                    if not spans:
                        continue
                    hit = np.concatenate([at[s] for s in spans])
                    scores = np.round(np.bincount(hit, np.concatenate([w[s] for s in spans]), len(names)), 10)
                    met = np.unique(hit)
                    best = met[np.argsort(-scores[met], kind="stable")[:k]]
                    out.append((np.full(len(best), q), best, scores[best]))
                if out:
                    q, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([asking.dictionary.take(pa.array(q)), names.take(pa.array(i)), pa.array(s)], ["query", "item", "score"])

    return run


def sparse_top_k(queries: DataFrame, weights: DataFrame, query_id: str, query_text: str, item_id: str, k: int = FIRST_PASS) -> DataFrame:
    """Dot product over shared terms; a query term counts once.  Ranks go by ten decimals, below which sums depend on their order."""
    asked = terms(queries, query_id, query_text).select(F.col(query_id).alias("query"), "term").where("query is not null")
    known = weights.join(F.broadcast(asked.select("term").distinct()), "term", "left_semi").where(F.col(item_id).isNotNull())
    packs = max(1, -(-queries.count() // SPARSE_QUERIES)), max(1, -(-weights.count() // SPARSE_ENTRIES))
    packed = lambda rows, name, n: rows.groupBy(F.pmod(F.xxhash64(name), F.lit(n)).alias("_b")).agg(*(F.collect_list(c).alias(f"{name}_{c}") for c in rows.columns)).drop("_b")
    left = packed(asked.select("query", "term"), "query", packs[0])
    right = packed(known.select(F.col(item_id).alias("item"), "term", F.col("weight").cast("double").alias("weight")), "item", packs[1])
    kinds = dict(asked.dtypes)["query"], dict(weights.dtypes)[item_id]
    # A query meets a pack of items in one task and leaves k rows, so no pair of query and item is a row.
    scored = left.crossJoin(right).mapInArrow(_sparse_scorer(k), f"query {kinds[0]}, item {kinds[1]}, score double")
    return top_k(scored, "query", "item", "score", k).withColumn("score", F.round("score", 4))


def _word_packs(batches):
    """A row a batch: the lists (item, term, tf, dl) of its items, from (item, words)."""
    for batch in batches:
        items, words = batch.column(0), batch.column(1)
        lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(words).dictionary_encode()
        if not len(flat):
            continue
        own = np.repeat(np.arange(len(items)), lengths) * len(flat.dictionary) + flat.indices.to_numpy()
        met, tf = np.unique(own, return_counts=True)
        at, term = np.divmod(met, len(flat.dictionary))
        columns = [items.take(pa.array(at)), flat.dictionary.take(pa.array(term)), pa.array(tf.astype(np.int64)), pa.array(lengths[at])]
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["items", "terms", "tf", "dl"])


def _word_scorer(k: int):
    """``_sparse_scorer`` of packs of items whose weights are still to be made, for the terms that the queries ask for."""

    def weighed(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q_names, q_terms, q_idf, items, terms_, tf, dl = (batch.column(i)[row].values for i in range(7))
                asked = q_terms.dictionary_encode()
                idf = np.empty(len(asked.dictionary))
                idf[asked.indices.to_numpy()] = q_idf.to_numpy()
                place = pc.index_in(terms_, value_set=asked.dictionary)
                known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                if not len(known):
                    continue
                n, length, mean = tf.to_numpy()[known], dl.to_numpy()[known], batch.column(7)[row].as_py()
                weight = idf[place.take(pa.array(known)).to_numpy()] * n * (BM25_K1 + 1) / (n + BM25_K1 * (1 - BM25_B + BM25_B * length / mean))
                columns = [q_names, q_terms, items.take(pa.array(known)), terms_.take(pa.array(known)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns], ["q", "qt", "i", "t", "w"])

    return lambda batches: _sparse_scorer(k)(weighed(batches))


def word_top_k(queries: DataFrame, texts: DataFrame, query_id: str, query_text: str, item_id: str, item_text: str, k: int = FIRST_PASS, pool: DataFrame | None = None) -> DataFrame:
    """``sparse_top_k`` by the weights of (item, text), one text an item, or of those in ``pool`` alone, without a row for a word.

    Words are counted where their text is read, and a batch of texts meets the queries there; what is shuffled are counts of
    the asked terms and k rows a query and batch.
    """
    asked = terms(queries, query_id, query_text).select(F.col(query_id).alias("query"), "term").where("query is not null")
    vocabulary = F.broadcast(asked.select("term").distinct())
    cut = texts.select(F.col(item_id).alias("item"), F.coalesce(_words(item_text), F.array().cast("array<string>")).alias("words"))
    named = cut.where("item is not null")
    # Texts without an id are one item for the counts, and no candidate.
    loose = terms(texts.where(F.col(item_id).isNull()), item_id, item_text)
    held = unnested(named, F.array_distinct("words"), "term").join(vocabulary, "term", "left_semi").select("term").unionByName(loose.join(vocabulary, "term", "left_semi").select("term"))
    lengths = named.select(F.size("words").cast("long").alias("dl")).unionByName(loose.agg(F.sum("tf").alias("dl"))).where("dl > 0")
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = asked.join(held.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(F.broadcast(corpus)).select("query", "term", idf.alias("idf"), "avgdl")
    packs = max(1, -(-queries.count() // SPARSE_QUERIES))
    left = rated.groupBy(F.pmod(F.xxhash64("query"), F.lit(packs)).alias("_b")).agg(*(F.collect_list(c).alias(f"q_{c}") for c in ("query", "term", "idf")), F.first("avgdl").alias("avgdl"))
    own = named if pool is None else named.join(pool.select(F.col(item_id).alias("item")), "item", "left_semi")
    kinds = dict(asked.dtypes)["query"], dict(own.dtypes)["item"]
    right = own.mapInArrow(_word_packs, f"items array<{kinds[1]}>, terms array<string>, tf array<long>, dl array<long>")
    met = right.crossJoin(F.broadcast(left)).select("q_query", "q_term", "q_idf", "items", "terms", "tf", "dl", "avgdl")
    scored = met.mapInArrow(_word_scorer(k), f"query {kinds[0]}, item {kinds[1]}, score double")
    return top_k(scored, "query", "item", "score", k).withColumn("score", F.round("score", 4))


# --- fusion, reranking, hydration -------------------------------------------------------


def fuse(legs: dict[str, DataFrame], k: int = RRF_K, top: int = FIRST_PASS) -> DataFrame:
    """Reciprocal-rank fusion of ranked legs (query, item, rank, score); each leg's score is kept."""
    rows = None
    for name, leg in legs.items():
        own = leg.select("query", "item", "rank", *(F.col("score").alias(f"{n}_score") if n == name else F.lit(None).cast("double").alias(f"{n}_score") for n in legs))
        rows = own if rows is None else rows.unionByName(own)
    fused = rows.groupBy("query", "item").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 14).alias("rrf_score"), *(F.max(f"{n}_score").alias(f"{n}_score") for n in legs))
    return top_k(fused, "query", "item", "rrf_score", top).withColumn("rrf_score", F.round("rrf_score", 8))


def lexical_overlap(query: Column, text: Column) -> Column:
    """A pluggable default scorer: the share of query words that the text holds."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(TERM), F.lit(0)))
    return F.round(F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1)), 6)


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column] | None, query_text: str, item_text: str, k: int = RERANKED) -> DataFrame:
    """The k best of the first pass by the scorer, stable; without one, its first k."""
    if scorer is None:
        return candidates.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
    scored = candidates.withColumn("rerank_score", scorer(F.col(query_text), F.col(item_text)))
    order = Window.partitionBy("query").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).withColumn("rank", F.col("_n").cast("long")).drop("_n")


def effective_score(*scores: str) -> Column:
    return F.coalesce(*(F.col(s) for s in scores), F.lit(0.0))


def hydrate(children: DataFrame, parents: DataFrame, score: str, k: int) -> DataFrame:
    """One row a parent: its best child, its contributors in order, its text; the k best a query."""
    own = F.coalesce("parent_chunk_id", "child_chunk_id")
    best = children.withColumn("_p", own).groupBy("query", "_p").agg(F.max(score).alias("score"), F.max_by("child_chunk_id", F.struct(F.col(score), -F.col("rank"))).alias("best_child"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "child_chunk_id"))), lambda s: s["child_chunk_id"]).alias("contributors"))
    # k rows a query: made once, and only their parents' texts are looked up.
    top = stages.temporary(top_k(best, "query", "_p", "score", k), "hydrated")
    texts = parents.select(F.col("parent_chunk_id").alias("_p"), "parent_text").join(F.broadcast(top.select("_p").distinct()), "_p", "left_semi").distinct()
    out = top.join(texts, "_p", "left").withColumnRenamed("_p", "parent_chunk_id")
    return out.select(*(c for c in out.columns if c != "rank"), "rank")


# --- gold pools -------------------------------------------------------------------------

MIN_POOL, MAX_POOL = 2, 50


def gold_pools(rows: DataFrame, keys: list[str], item: str, least: int = MIN_POOL, most: int = MAX_POOL) -> DataFrame:
    """(keys.., pool): the first ``most`` items of each group of ``least`` or more, by rank, so that no group is gathered whole."""
    own = Window.partitionBy(*keys).orderBy(item)
    first = rows.select(*keys, item, F.row_number().over(own).alias("_n")).where(F.col("_n") <= most)
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("pool")).where(F.size("pool") >= least)


def gold_queries(rows: DataFrame, n: int, seed: int, item: str, text: str, name: str, place: str) -> DataFrame:
    """(item, query, pool, stratum) of ``n`` rows, by seeded hash, whose ``name`` another row has too; the pool is of the same name and place."""
    counts = rows.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_c")).where(F.col("_c") >= MIN_POOL).select("_name")
    valid = rows.join(counts, F.col(name) == F.col("_name"), "left_semi")
    drawn = sample_n(valid.select(item, F.col(text).alias("query"), name, place), n, seed, item)
    pools = gold_pools(rows, [name, place], item, 1).withColumnsRenamed({name: "_pool_name", place: "_pool_place"})
    stratum = F.concat(F.lit("title="), F.substring(name, 1, 40), F.lit(" country="), F.coalesce(place, F.lit("None")))
    found = drawn.join(pools, (F.col(name) == F.col("_pool_name")) & F.col(place).eqNullSafe(F.col("_pool_place")))
    return found.select(item, "query", "pool", stratum.alias("stratum"))


# --- evaluation -------------------------------------------------------------------------


def first_per_item(ranked: DataFrame, item: str, k: int) -> DataFrame:
    """Ranked lists with each item once, at its first place."""
    once = ranked.groupBy("query", F.col(item).alias("item")).agg(F.min("rank").alias("_r"))
    order = Window.partitionBy("query").orderBy("_r", "item")
    return once.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("_r")


def query_metrics(ranked: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20), ndcg_at: int = 10) -> DataFrame:
    """(query, n_relevant, recall@k.., rr, ndcg) of each query that has relevant items."""
    size = relevant.groupBy("query").agg(F.count("*").alias("n_relevant"))
    return hit_metrics(ranked.join(relevant.select("query", "item"), ["query", "item"], "left_semi"), size, cutoffs, ndcg_at)


def hit_metrics(hits: DataFrame, size: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20), ndcg_at: int = 10) -> DataFrame:
    """``query_metrics`` from the relevant rows of rankings and (query, n_relevant), where relevant pairs are too many to list."""
    gain = F.when(F.col("rank") <= ndcg_at, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = hits.groupBy("query").agg(*(F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in cutoffs), F.min("rank").alias("_first"), F.sum(gain).alias("_dcg"))
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(ndcg_at)).cast("int")), lambda i: 1 / F.log2(i + 1)), F.lit(0.0), lambda s, x: s + x)
    out = size.join(per, "query", "left")
    return out.select("query", "n_relevant", *(F.round(F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.col("n_relevant"), 6).alias(f"recall_{k}") for k in cutoffs), F.round(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("_dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def summarise(metrics: DataFrame) -> DataFrame:
    """Means over eligible queries; zeros when there are none."""
    names = [c for c in metrics.columns if c not in ("query", "n_relevant", "variant")]
    return metrics.agg(F.count("*").alias("n_queries"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in names))
