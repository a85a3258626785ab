"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one full-dimensional codeword from each of
``CODEBOOKS`` codebooks.  The codebooks start as residual k-means and are refitted
together by least squares; codes are found by beam search over the codebooks.
Beside its code a vector stores the ratio of its norm to its code's, which puts
the length that coding loses back into the score, and the length of what is left,
which bounds the score's error.  A query's products with all codewords make a
table; a coded vector's score is the sum of one entry a codebook, times that ratio.
The best ``candidates`` of a block by that score are scored exactly, in double
precision; so is every other row that the bound does not place below the k-th of
these, however many they are.  No neighbour is lost to the codes.

Cost at scale.  The fit uses ``FIT_ROWS`` rows (those with the smallest hashed
ids); every row is coded.  Rows are dealt to cells around centres fitted to the same
rows, and packed cell by cell in blocks of ``BLOCK_BYTES`` of vectors; queries are packed by their most
promising cell.  Each task scores one pack of queries against one block and returns k rows a
query.  A pack first meets the blocks of its own cell, which gives its queries their
k-th score so far; after that it meets a cell only if one of its queries could still find a row
there: no row of a cell is further from the centre than the cell's radius, so none scores
above the centre's product plus the radius times the query's length.  So rows in clusters
meet few packs, and a block is sent once for ``QUERY_ROWS`` queries at most.
Tied scores go to the smaller id in every step, so any number of equal vectors
gives the same result.

Defined results.  Vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do null ids.  Vectors of another length have no product
with a query, so each length is searched among its own, with codebooks of its own.
Vectors are coded in units of their largest component, so their size is no matter;
where a k-th score is out of the range in which bounds hold (zero, tiny or not
finite), all rows are scored exactly.  A score that is no number comes last.
Rows that share an id count once, with the smallest vector.  Fewer candidates
than asked for are all returned; an empty table gives no rows.  Only the id and
vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

CODEBOOKS, CODEWORDS, BEAM = 24, 128, 8
FIT_ROWS = 8192
BLOCK_BYTES, MOST_CELLS = 1 << 23, 1024
QUERY_ROWS = 2048
CANDIDATES = 400


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    near = lambda: np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), 1)
    for _ in range(rounds):
        own = near()
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(x.dtype)
    return centres, near()


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, codebooks) by beam search: the ``beam`` best partial sums are carried from book to book."""
    rest, codes = x[:, None, :], np.zeros((len(x), 1, 0), np.uint8)
    for words in books:
        far = (words * words).sum(1) - 2 * (rest @ words.T) + (rest * rest).sum(2)[:, :, None]
        far = far.reshape(len(x), -1)
        keep = min(beam, far.shape[1])
        best = np.argpartition(far, keep - 1, 1)[:, :keep]
        parent, word = best // len(words), best % len(words)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[np.arange(len(x)), (rest * rest).sum(2).argmin(1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, seed: int = 11, rounds: int = 2) -> np.ndarray:
    """Codebooks (codebooks, codewords, dimensions) for the rows of x."""
    rng = np.random.default_rng(seed)
    rest, books = x.copy(), []
    for _ in range(codebooks):
        words, own = _kmeans(rest, codewords, rng)
        rest = rest - words[own]
        books.append(words)
    books = np.stack(books)
    for _ in range(rounds):
        codes = np.concatenate([encode(x[i : i + 1024], books, 4) for i in range(0, len(x), 1024)])
        chosen = np.zeros((len(x), codebooks * codewords), np.float32)
        chosen[np.arange(len(x))[:, None], codes + np.arange(codebooks) * codewords] = 1
        gram = chosen.T @ chosen + 0.1 * np.eye(chosen.shape[1], dtype=np.float32)
        books = np.linalg.solve(gram, chosen.T @ x).reshape(books.shape).astype(np.float32)
    return books


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, width)


def in_units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in units of their largest component, in single precision; those components)."""
    scale = np.abs(x).max(1)
    return (x / scale[:, None]).astype(np.float32), scale


def _away(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, distance to it, rounded up) of each row; what cannot be told is infinitely far."""
    with np.errstate(all="ignore"):
        cell = np.argmin(np.nan_to_num((centres * centres).sum(1) - 2 * (x @ centres.T), nan=np.inf, posinf=np.inf, neginf=-np.inf), 1)
        rest = x - centres[cell]
        size = np.abs(rest).max(1)
        far = size * np.sqrt(((rest / np.where(size > 0, size, 1)[:, None]) ** 2).sum(1)) * (1 + 1e-9)
    return cell.astype(np.int32), np.where(np.isfinite(far), far, np.inf)


def _encoder(books: np.ndarray, centres: np.ndarray):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                cell, far = _away(_matrix(part.column(1), books.shape[2]), centres)
                x, scale = in_units(_matrix(part.column(1), books.shape[2]))
                codes = encode(x, books)
                decoded = decode(codes, books)
                made, size = np.linalg.norm(decoded, axis=1), np.linalg.norm(x, axis=1)
                ratio = size / np.where(made > 0, made, 1)
                # The second term covers what single precision loses.
                error = np.linalg.norm(x - ratio[:, None] * decoded, axis=1) + 1e-4 * (size + ratio * np.abs(books).max() * len(books))
                with np.errstate(over="ignore"):
                    ratio, error = ratio * scale, error * scale
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio), pa.array(error), part.column(1), pa.array(cell), pa.array(far)], ["id", "code", "ratio", "error", "vector", "cell", "far"])

    return run


def _pack_codes(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    packed = lambda name: pa.array([table[name].to_numpy().tobytes()])
    vectors = pc.list_flatten(table["vector"].combine_chunks()).to_numpy(zero_copy_only=False)
    return pa.table({"cell": table["cell"][:1], "ids": packed("id"), "codes": pa.array([b"".join(table["code"].to_pylist())]), "ratios": packed("ratio"), "errors": packed("error"), "rows": pa.array([vectors.tobytes()])})


def _pack_queries(table: pa.Table) -> pa.Table:
    vectors = pc.list_flatten(table["vector"].combine_chunks()).to_numpy(zero_copy_only=False)
    packed = lambda name: pa.array([table[name].to_numpy().tobytes()])
    return pa.table({"own": table["own"][:1], "queries": packed("id"), "vectors": pa.array([vectors.tobytes()]), "least": packed("least")})


def _promising(centres: np.ndarray):
    """The cell whose centre scores best, for each query."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                with np.errstate(all="ignore"):
                    score = np.nan_to_num(_matrix(batch.column(1), centres.shape[1]) @ centres.T, nan=-np.inf)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score.argmax(1).astype(np.int32))], ["id", "vector", "own"])

    return run


def _reachable(centres: np.ndarray, radii: np.ndarray):
    """Each pack with each cell, but its own, that may hold a row as good as the k-th of one of its queries."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vectors, least = (np.frombuffer(batch.column(c)[i].as_py()) for c in (2, 3))
                vectors = vectors.reshape(len(least), -1)
                with np.errstate(all="ignore"):
                    best = vectors @ centres.T + np.linalg.norm(vectors, axis=1)[:, None] * radii
                    # A hair is given to what adding in another order may change.
                    size = np.abs(vectors) @ np.abs(centres).T + np.linalg.norm(vectors, axis=1)[:, None] * radii
                    open_ = ~(best + 1e-9 * size < least[:, None]) & (radii >= 0)
                cells = np.flatnonzero(open_.any(0))
                cells = cells[cells != batch.column(0)[i].as_py()]
                if len(cells):
                    rows = pa.array(np.full(len(cells), i))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), *(batch.column(c).take(rows) for c in (1, 2, 3))], ["cell", "queries", "vectors", "least"])

    return run


def best_of(scores: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest scores; among equal ones the earlier places."""
    if len(scores) <= count:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - count)[len(scores) - count]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: count - len(above)]])


def _products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the dimensions, so that equal vectors score alike."""
    out = np.zeros(len(rows))
    for j in range(len(query)):
        out += query[j] * rows[:, j]
    return out


def _exact_best(query: np.ndarray, approximate: np.ndarray, errors: np.ndarray, rows: np.ndarray, taking: np.ndarray, k: int, candidates: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best rows among those ``taking`` part; what the error bound leaves open is scored exactly.

    ``approximate`` is in units of the query's largest component.
    """
    scale = np.abs(query).max()
    unit = query / scale
    with np.errstate(all="ignore"):
        reach = approximate + np.linalg.norm(unit) * errors
        reach = np.where(taking, np.where(np.isfinite(reach), reach, np.inf), -np.inf)
        places = np.flatnonzero(taking)
        if len(places) > k:
            first = best_of(np.where(taking, np.where(np.isfinite(approximate), approximate, np.inf), -np.inf), max(k, candidates))
            first = first[taking[first]]
            near = rows[first] @ unit
            least = np.partition(near, len(near) - k)[len(near) - k]
            if np.isfinite(near).all() and 1e-290 < abs(least) * min(scale, 1) and abs(least) * max(scale, 1) < 1e300:
                places = np.flatnonzero(reach >= least - 1e-9 * abs(least))
        scores = _products(rows[places], query)
    none = np.isnan(scores)
    best = np.lexsort((places, -scores, none))[:k] if none.any() else best_of(scores, k)
    return places[best], scores[best]


def _scorer(books: np.ndarray, k: int, candidates: int, slice_rows: int = 64):
    def run(batches):
        for batch in batches:
            for queries, vectors, least, ids, codes, ratios, errors, rows in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                least = np.frombuffer(least)
                queries, ids = np.frombuffer(queries, np.int64), np.frombuffer(ids, np.int64)
                ratios, errors = np.frombuffer(ratios), np.frombuffer(errors)
                vectors, rows = np.frombuffer(vectors).reshape(len(queries), -1), np.frombuffer(rows).reshape(len(ids), -1)
                codes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(len(ids), -1).T)
                for i in range(0, len(queries), slice_rows):
                    tables = np.einsum("qd,mkd->mqk", in_units(vectors[i : i + slice_rows])[0], books, optimize=True)
                    scores = np.zeros((tables.shape[1], len(ids)), np.float32)
                    for table, code in zip(tables, codes, strict=True):
                        scores += table[:, code]
                    out_query, out_id, out_score = [], [], []
                    for query, vector, row, known in zip(queries[i : i + slice_rows], vectors[i : i + slice_rows], scores, least[i : i + slice_rows], strict=True):
                        with np.errstate(over="ignore", invalid="ignore"):
                            best, exact = _exact_best(vector, row * ratios, errors, rows, ids != query, k, candidates)
                        some = ~(exact < known)
                        best, exact = best[some], exact[some]
                        out_query.append(np.full(len(best), query))
                        out_id.append(ids[best])
                        out_score.append(exact)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_query, out_id, out_score)], ["query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row, itself left out, by inner product."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    base = base.where(F.col("id").isNotNull() & usable(F.col("vector")))
    base = materialize(base.groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks")), "vectors")
    # One row a length; a table of vectors has one length, or few.
    lengths = base.groupBy(F.size("vector").alias("width")).count().orderBy("width").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for length in lengths:
        out = out.union(_nearest_of(base.where(F.size("vector") == length.width), length.width, length["count"], k, candidates, codebooks, codewords))
    return out


def _nearest_of(base: DataFrame, width: int, count: int, k: int, candidates: int, codebooks: int, codewords: int) -> DataFrame:
    """``nearest`` among (id, vector, asks) of one length."""
    sample = base.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    books = fit(in_units(_matrix(sample["vector"].combine_chunks(), width))[0], codebooks, min(codewords, max(1, sample.num_rows)))

    cells = min(MOST_CELLS, sample.num_rows, max(1, -(-count * width * 8 // BLOCK_BYTES)))
    rows = _matrix(sample["vector"].combine_chunks(), width)
    with np.errstate(all="ignore"):
        centres = np.nan_to_num(_kmeans(rows, cells, np.random.default_rng(23))[0], nan=0.0, posinf=0.0, neginf=0.0)
    coded = base.select("id", "vector").mapInArrow(_encoder(books, centres), "id long, code binary, ratio double, error double, vector array<double>, cell int, far double")
    coded = materialize(coded, "coded")
    # One row a cell.
    held = {r.cell: r for r in coded.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    radii = np.array([held[c].far if c in held else -np.inf for c in range(cells)])
    pieces = [-(-held[c].n * width * 8 // BLOCK_BYTES) if c in held else 1 for c in range(cells)]
    piece = lambda cell, sizes: F.pmod(F.xxhash64("id"), F.get(F.array(*(F.lit(n) for n in sizes)), F.col(cell)))
    packed = coded.withColumn("piece", piece("cell", pieces)).groupBy("cell", "piece").applyInArrow(_pack_codes, "cell int, ids binary, codes binary, ratios binary, errors binary, rows binary")
    packed = materialize(packed, "blocks")

    asking = materialize(base.where("asks").select("id", "vector").mapInArrow(_promising(centres), "id long, vector array<double>, own int"), "asking")
    asked = {r.own: r.n for r in asking.groupBy("own").agg(F.count("*").alias("n")).collect()}
    shares = [max(1, -(-asked.get(c, 0) // QUERY_ROWS)) for c in range(cells)]

    def packs(rows: DataFrame) -> DataFrame:
        return rows.withColumn("piece", piece("own", shares)).groupBy("own", "piece").applyInArrow(_pack_queries, "own int, queries binary, vectors binary, least binary")

    columns = ("queries", "vectors", "least", "ids", "codes", "ratios", "errors", "rows")
    scored = "query_id long, vec_id long, score double"
    near = packs(asking.withColumn("least", F.lit(float("-inf")))).withColumnRenamed("own", "cell")
    first = materialize(near.join(packed, "cell").select(*columns).mapInArrow(_scorer(books, k, candidates), scored), "first")
    last = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(last)).where((F.col("rank") == k) & ~F.isnan("score")).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    known = asking.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    far = packs(known).mapInArrow(_reachable(centres, radii), "cell int, queries binary, vectors binary, least binary")
    second = far.join(packed, "cell").select(*columns).mapInArrow(_scorer(books, k, candidates), scored)
    return first.union(second).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
