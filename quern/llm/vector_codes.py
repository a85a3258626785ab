"""Product codes of integer vectors, with nearest entries found in vantage-point trees.

Components become integers, floor(4096 * x); a vector is cut into ``PARTS`` parts, each
with a codebook of ``ENTRIES`` entries that starts from the vectors of the smallest ids.  A
round assigns every part to its nearest entry and replaces each entry by the
rounded-down mean of its parts.  All of it is integer arithmetic, so results do not
depend on how rows are dealt.

The nearest entry comes from a vantage-point tree over the codebook of each part
position, searched by branch and bound for a batch of vectors at once.  Bounds are
whole numbers on the safe side: a query's distance to a vantage point is bracketed
by whole square roots, an inner ball's radius is rounded up and an outer shell's
down, and a branch is visited unless its bound is strictly worse than the best
distance rounded up.  Entries reached are compared by their exact squared distance,
ties to the lower index, so no rounding can change a code.

Cost at scale.  The kept rows are written once; a round reads them, and each task
returns one row of sums a codebook component, so a round shuffles some thousand rows
a task and the driver sees one sum a component.  Sums travel in limbs of 32 bits.

Defined results.  Rows whose vector is null or holds a null or non-finite component are
dropped.  Vectors of another length have codebooks of their own; a length that 8 does
not divide is cut at floor(i * length / 8), so parts may differ by one component or be
empty.  Fewer rows than entries give as many entries as rows.  Repeated ids are
rows of their own; starting entries are taken by id, then vector, null ids last.
Components of any size are exact, beyond 64 bits in Python's integers; an error that
a long cannot hold is null, and so is a label's sum.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LEAF = 3


def cuts(width: int, parts: int = PARTS) -> list[tuple[int, int]]:
    return [(i * width // parts, (i + 1) * width // parts) for i in range(parts)]


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): longs where squared distances of such rows fit, else Python's integers."""
    largest = np.abs(x).max(initial=0.0)
    if x.shape[1] * (2.0 * SCALE * largest + 2) ** 2 < 2.0**62:
        return np.floor(SCALE * x).astype(np.int64)
    exact = [SCALE * int(v) if abs(v) >= 2.0**53 else math.floor(SCALE * v) for v in x.ravel().tolist()]
    out = np.empty(x.size, object)
    out[:] = exact
    return out.reshape(x.shape)


def squared(q: np.ndarray, entry: np.ndarray) -> np.ndarray:
    if q.dtype == object or entry.dtype == object:
        q, entry = q.astype(object), entry.astype(object)
    rest = q - entry
    return (rest * rest).sum(1) if rest.shape[1] else np.zeros(len(q), np.int64)


def root_down(x: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down."""
    if x.dtype == object:
        return np.array([math.isqrt(v) for v in x], object)
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def root_up(x: np.ndarray) -> np.ndarray:
    r = root_down(x)
    return r + (r * r < x)


@dataclass
class Tree:
    """A vantage entry, its inner ball up to ``ball`` and its outer shell from ``shell`` to ``rim``; a leaf has entries alone."""

    entries: list[int]
    ball: int = 0
    shell: int = 0
    rim: int = 0
    inner: Tree | None = None
    outer: Tree | None = None


def build(book: np.ndarray, entries: list[int] | None = None) -> Tree:
    """The vantage-point tree of a codebook (entries, components)."""
    entries = list(range(len(book))) if entries is None else entries
    if len(entries) <= LEAF:
        return Tree(entries)
    point, rest = entries[0], entries[1:]
    away = squared(book[rest], book[point])
    order = np.argsort(away, kind="stable")
    half = (len(rest) + 1) // 2
    inner, outer = order[:half], order[half:]
    near, far = root_up(away), root_down(away)
    return Tree([point], near[inner].max(), far[outer].min(), near[outer].max(), build(book, [rest[i] for i in inner]), build(book, [rest[i] for i in outer]))


def search(tree: Tree, book: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for each row of q; ties go to the lower index."""
    kind = object if q.dtype == object or book.dtype == object else np.int64
    best, index = np.full(len(q), -1, kind), np.full(len(q), len(book))

    def verify(rows: np.ndarray, entry: int) -> np.ndarray:
        away = squared(q[rows], book[entry])
        better = (best[rows] < 0) | (away < best[rows]) | ((away == best[rows]) & (entry < index[rows]))
        better = better.astype(bool)
        best[rows[better]], index[rows[better]] = away[better], entry
        return away

    def visit(node: Tree | None, rows: np.ndarray) -> None:
        if node is None or not len(rows):
            return
        for entry in node.entries:
            away = verify(rows, entry)
        if node.inner is None:
            return
        low, high = root_down(away), root_up(away)
        inside = (low <= node.ball).astype(bool)

        def into(child: Tree, least: np.ndarray, some: np.ndarray) -> None:
            # Not strictly worse than the best so far: an equal distance may belong to a lower index.
            visit(child, rows[some & (least <= root_up(best[rows])).astype(bool)])

        ball = low - node.ball
        shell = np.maximum(node.shell - high, low - node.rim)
        into(node.inner, ball, inside)
        into(node.outer, shell, inside)
        into(node.outer, shell, ~inside)
        into(node.inner, ball, ~inside)

    visit(tree, np.arange(len(q)))
    return index, best


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), width)


def _fitting(book: np.ndarray) -> np.ndarray:
    """Longs where products of a codebook's entries are sure to fit, else Python's integers."""
    largest = max((abs(v) for v in book.ravel().tolist()), default=0)
    return book.astype(np.int64) if (book.shape[1] + 1) * (2 * largest + 2) ** 2 < 2**62 else book.astype(object)


def _assigned(x: np.ndarray, books: list[np.ndarray], trees: list[Tree]):
    """(part, its rows in integers, indexes, squared distances), part by part."""
    q = to_integers(x)
    for part, (a, b) in enumerate(cuts(x.shape[1])):
        yield part, q[:, a:b], *search(trees[part], books[part], q[:, a:b])


def limbs(value: int) -> list[int]:
    """value as a sum of limbs[i] * 2**(32 * i), each a small integer."""
    out = []
    while not -(2**31) <= value < 2**31:
        value, low = value >> 32, value & (2**32 - 1)
        out.append(low)
    return [*out, value]


def _summer(books: list[np.ndarray], width: int):
    """Sums and counts of the parts that each entry is nearest to; place -1 holds the count."""
    trees = [build(b) for b in books]
    size = len(books[0])

    def run(batches):
        counts, sums = np.zeros((PARTS, size), np.int64), [np.zeros((size, b - a), object) for a, b in cuts(width)]
        for batch in batches:
            if not batch.num_rows:
                continue
            for part, q, index, _ in _assigned(_matrix(batch.column(0), width), books, trees):
                counts[part] += np.bincount(index, minlength=size)
                by = np.argsort(index, kind="stable")
                used, first = np.unique(index[by], return_index=True)
                if q.shape[1]:
                    # A batch's sums fit: components are below 2**31 where they are longs.
                    sums[part][used] += np.add.reduceat(q[by], first, 0).astype(object)
        rows = [(p, e, -1, i, v) for p in range(PARTS) for e in range(size) for i, v in enumerate(limbs(int(counts[p, e])))]
        rows += [(p, e, at, i, v) for p in range(PARTS) for e, line in enumerate(sums[p]) for at, total in enumerate(line) for i, v in enumerate(limbs(int(total))) if v]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["part", "entry", "place", "limb", "value"])

    return run


def _coder(books: list[np.ndarray], width: int):
    trees = [build(b) for b in books]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            total, codes = 0, []
            for _, _, index, away in _assigned(_matrix(batch.column(2), width), books, trees):
                total, codes = total + away.astype(object), [*codes, index]
            text = [bytes(row).hex() for row in np.stack(codes, 1).astype(np.uint8)]
            error = pa.array([v if v < 2**63 else None for v in total], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), error], ["id", "row", "code", "error"])

    return run


def codebooks_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(v)) for book in books for entry in book for v in entry)


def fit(vectors: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks by part after ``rounds`` rounds over all rows of (id, vector)."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").toArrow()
    start = to_integers(_matrix(first["vector"].combine_chunks(), width))
    books = [_fitting(start[:, a:b]) for a, b in cuts(width)]
    for _ in range(rounds):
        sums = vectors.select("vector").mapInArrow(_summer(books, width), "part long, entry long, place long, limb long, value long")
        totals: dict[tuple[int, int, int], int] = {}
        for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
            key = (r.part, r.entry, r.place)
            totals[key] = totals.get(key, 0) + (int(r.value) << (32 * r.limb))
        after = []
        for part, book in enumerate(books):
            new = book.astype(object)
            for e in range(len(new)):
                if n := totals.get((part, e, -1), 0):
                    new[e] = [totals.get((part, e, at), 0) // n for at in range(new.shape[1])]
            after.append(_fitting(new))
        books = after
    return books


def kept(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per kept row of ``vectors``."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    base = materialize(base.where(kept(F.col("vector"))), "integers")
    coded = None
    # One row a length; a table of vectors has one length, or few.
    for length in base.select(F.size("vector").alias("width")).distinct().orderBy("width").collect():
        of = base.where(F.size("vector") == length.width)
        books = fit(of, length.width)
        digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
        rows = of.select("id", F.struct("label").alias("row"), "vector").mapInArrow(_coder(books, length.width), f"id long, row struct<label: {base.schema['label'].dataType.simpleString()}>, code string, error long")
        rows = rows.select("id", "row.label", "code", "error", F.lit(digest).alias("codebooks_sha256"))
        coded = rows if coded is None else coded.union(rows)
    if coded is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # Written before the join, which then is one of plain shuffles: a label with many rows is split.
    coded = materialize(coded, "codes")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    known = F.count("error") == F.count("*")
    sums = materialize(coded.groupBy("label").agg(F.when(known, whole).try_cast("long").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    out = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
