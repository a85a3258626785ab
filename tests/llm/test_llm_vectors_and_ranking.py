"""Near vectors, vector codes and ranked search against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import impact_index, neighbour_graph, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int, node long, component long, id long, weight long"


def hostile_vectors():
    """Copies, tight groups of several sizes, a chain, opposite and scaled vectors, and all that takes no part."""
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(rng.normal(size=12)) for _ in range(150)]
    for size, spread in ((90, 0.02), (70, 0.06), (20, 0.05), (2, 0.01)):
        centre = unit(rng.normal(size=12))
        rows += [unit(centre + spread * rng.normal(size=12)) for _ in range(size)]
    a, b = unit(rng.normal(size=12)), unit(rng.normal(size=12))
    rows += [unit((1 - t) * a + t * b) for t in np.linspace(0, 1, 15)]
    rows += [rows[7]] * 5 + [rows[160]] * 3 + [-rows[3], 1e200 * rows[9], 1e-200 * rows[9]]
    out = [(i, v.tolist()) for i, v in enumerate(rows)]
    at = len(out)
    bad = [None, [], [0.0] * 12, [1.0] * 11 + [None], [1.0] * 11 + [math.nan], [math.inf] + [0.0] * 11]
    out += [(at + i, v) for i, v in enumerate(bad)]
    out += [(at + 50, [3.0, 4.0]), (at + 51, [6.0, 8.0]), (at + 52, [4.0, -3.0]), (None, rows[7].tolist()), (7, rows[7].tolist()), (7, rows[9].tolist())]
    return out


def linked(rows, threshold):
    """(row, links, smallest id in reach) by comparing all pairs."""
    takes = [i for i, (v, x) in enumerate(rows) if v is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    unit = {i: neighbour_graph.unit_rows(np.array([rows[i][1]]))[0] for i in takes}
    near = {i: [j for j in takes if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in takes}
    least = {}
    for i in takes:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least[i] = min(rows[j][0] for j in seen)
    return [(v, len(near.get(i, [])), least.get(i, v)) for i, (v, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(v, x, (v or 0) % 3 or None, 1, 2, 3, 4) for v, x in hostile_vectors()], VECTORS).repartition(3)


@pytest.mark.parametrize(("longest", "block"), [(32, 1024), (8, 16)])
def test_near_vectors_equal_brute_force(spark, vectors, monkeypatch, longest, block):
    """With lists so short that groups are counted by balls, and with longer ones."""
    if block != 1024:
        count = neighbour_graph.dense_counts
        monkeypatch.setattr(neighbour_graph, "dense_counts", lambda members, threshold: count(members, threshold, block))
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbour_graph.near_vectors(vectors, longest=longest).collect()), key=repr)
    want = sorted(((v, n, c, v == c) for v, n, c in linked(hostile_vectors(), 0.95)), key=repr)
    assert got == want


def test_near_vectors_of_nothing(spark, vectors):
    assert neighbour_graph.near_vectors(vectors.where("false")).count() == 0
    only = neighbour_graph.near_vectors(vectors.where("embedding is null")).collect()
    assert [(r.n_links, r.kept) for r in only] == [(0, True)]


def test_lists_grow_when_full_of_links():
    rows = np.zeros(12, int)
    others, sims = np.arange(12) % 10, np.linspace(1, 0.9, 12)
    kept, owner, sizes = neighbour_graph.merge_lists(rows, others, sims, np.zeros(12, bool), np.array([2]), 0.95, 8)
    # Six of the ten others are links, so two and four are too few places, and eight are not.
    assert sizes.tolist() == [8] and len(kept) == 8 and len(set(others[kept])) == 8 and list(sims[kept]) == sorted(sims[kept], reverse=True)


def test_an_audit_sees_what_is_missing(spark, vectors):
    own = vectors.where("size(embedding) = 12 and label is not null").limit(60)
    units = spark.createDataFrame([(i, neighbour_graph.unit_rows(np.array([r.embedding]))[0].tolist(), 1) for i, r in enumerate(own.collect()) if all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)], "node long, unit array<double>, weight long")
    none = units.select("node", "weight", F.col("weight").alias("linked"))
    assert neighbour_graph.audit(none, units, 0.95) == 0.0
    x = np.array([r.unit for r in units.orderBy("node").collect()])
    counts = (x @ x.T >= 0.95).sum(1)
    ids = [r.node for r in units.orderBy("node").collect()]
    true = spark.createDataFrame([(n, 1, int(c)) for n, c in zip(ids, counts, strict=True)], "node long, weight long, linked long")
    assert neighbour_graph.audit(true, units, 0.95) == 1.0


def coded(rows):
    """Codes, errors and codebooks of (id, vector, label) in Python's integers, for one length."""
    width = len(rows[0][1])
    q = [[math.floor(4096 * x) if abs(x) < 2**53 else 4096 * int(x) for x in v] for _, v, _ in rows]
    spans = [(i * width // 8, (i + 1) * width // 8) for i in range(8)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:16]
    books = [[q[i][a:b] for i in first] for a, b in spans]
    far = lambda x, y: sum((s - t) ** 2 for s, t in zip(x, y, strict=True))

    def assign():
        return [[min((far(v[a:b], e), j) for j, e in enumerate(books[p])) for p, (a, b) in enumerate(spans)] for v in q]

    for _ in range(6):
        near = assign()
        for p, (a, b) in enumerate(spans):
            for j in range(len(books[p])):
                own = [v[a:b] for v, n in zip(q, near, strict=True) if n[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [("".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n)) for n in assign()], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("width", [24, 11, 3])
def test_codes_equal_plain_integers(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i % 70, rng.normal(0, 1, width).round(2).tolist(), i % 4 or None) for i in range(80)]
    rows += [(900 + i, [0.5] * width, 7) for i in range(5)] + [(None, [0.1] * width, 7), (950, [3e5] * width, 8), (951, [-1e150] * width, 9)]
    awkward = [(1, None, 1), (2, [None] * width, 1), (3, [math.nan] * width, 1), (4, [math.inf] * width, 1), (5, [1.0, 2.0, 3.0, 4.0, 5.0], 7)]
    frame = spark.createDataFrame([(i, v, lab, 1, 2, 3, 4) for i, v, lab in rows + awkward], VECTORS).repartition(4)
    want, digest = coded(rows)
    other, other_digest = coded([awkward[-1]])
    every = [*zip(rows, want, strict=True), (awkward[-1], other[0])]
    fits = lambda v: v if v < 2**63 else None
    sums = {}
    for (_, _, lab), (_, e) in every:
        sums[lab] = None if fits(e) is None or sums.get(lab, 0) is None else sums.get(lab, 0) + e
    digests = lambda r: other_digest if r is awkward[-1] else digest
    expected = sorted((repr((r[0], code, fits(e), sums[r[2]], digests(r))) for r, (code, e) in every))
    got = sorted(repr(tuple(r)) for r in vector_codes.compress(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == expected


def test_codes_of_nothing(spark):
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, 1, 1, 1, 1)], VECTORS)).count() == 0


def test_trees_find_the_nearest_entry():
    rng = np.random.default_rng(0)
    for trial in range(40):
        width, n, reach = int(rng.integers(0, 6)), int(rng.integers(1, 17)), int(rng.choice([2, 5, 1000, 10**12]))
        book, q = rng.integers(-reach, reach, (n, width)), rng.integers(-reach, reach, (200, width))
        if trial % 2 or reach > 1000:
            book, q = book.astype(object), q.astype(object)
        away = np.stack([vector_codes.squared(q, e) for e in book], 1)
        index, best = vector_codes.search(vector_codes.build(book), book, q)
        assert list(index) == [min(range(n), key=lambda j: (row[j], j)) for row in away]
        assert list(best) == [row.min() for row in away]


def test_trees_pass_over_branches(monkeypatch):
    """Bounds do cut: far fewer distances than entries times vectors."""
    rng, seen = np.random.default_rng(1), []
    book = np.concatenate([rng.integers(0, 50, (8, 4)), rng.integers(100_000, 100_050, (8, 4))])
    tree, plain = vector_codes.build(book), vector_codes.squared
    monkeypatch.setattr(vector_codes, "squared", lambda q, e: seen.append(len(q)) or plain(q, e))
    vector_codes.search(tree, book, rng.integers(0, 50, (100, 4)))
    assert sum(seen) < 0.75 * 16 * 100


def test_roots_and_limbs():
    values = np.array([0, 1, 2, 3, 4, 8, 9, 2**52 - 1, 2**60, (2**30 - 1) ** 2, (2**30 - 1) ** 2 - 1])
    assert vector_codes.root_down(values).tolist() == [math.isqrt(v) for v in values.tolist()]
    assert vector_codes.root_up(values).tolist() == [math.isqrt(v) + (math.isqrt(v) ** 2 < v) for v in values.tolist()]
    for v in (0, -1, 5, 2**31, -(2**31), -(2**31) - 1, 2**70, -(2**70) + 3):
        assert sum(x << (32 * i) for i, x in enumerate(vector_codes.limbs(v))) == v


DOCS = "doc_id long, text string, item_id long, term string, block long, n long"
PATTERN = re.compile(impact_index.TERM)


def ranked(docs, items, k):
    terms = lambda t: PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            m = 100 - 25 + (25 * c.total() * n) // total
            weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in c}
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "group"), [(16_384, 256), (7, 2)])
def test_ranking_equals_brute_force(spark, rows, group):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Ab", "aB", "日本", "x1", "😀"]
    shares = 1 / np.arange(1, len(words) + 1)
    text = lambda n: " ".join(rng.choice(words, n, p=shares / shares.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(90)] + [(200 + i, docs_text) for i, docs_text in enumerate(["same words here"] * 30)]
    docs += [(300, None), (301, ""), (302, " ,.;-_ "), (303, text(20_000)), (5, "w1 w2"), (5, "w1 w2"), (None, "w1 w2"), (None, "same words here")]
    items = [(0, "w1 w2 w2 w2 w5"), (1, "SAME words Here"), (2, None), (3, ""), (4, "nothing known"), (5, "w3-w4/é"), (5, "w1 w2 w2 w2 w5"), (6, "w0 " * 9 + "É"), (0, "w1 w2 w2 w2 w5"), (7, "W0")]
    docs_frame = spark.createDataFrame([(d, t, 1, "t", 2, 3) for d, t in docs], DOCS).repartition(3)
    items_frame = spark.createDataFrame([(7, t, i, "t", 2, 3) for i, t in items], DOCS)
    index = impact_index.build_index(docs_frame, block_rows=rows, block_postings=400 if rows < 100 else impact_index.BLOCK_POSTINGS)
    got = sorted((tuple(r) for r in impact_index.search(index, items_frame, 20, group=group).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == ranked(docs, [(i, t) for i, t in items if t is not None], 20)


def test_ranking_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b", 1, "t", 2, 3)], DOCS), spark.createDataFrame([], DOCS)
    assert impact_index.search(impact_index.build_index(none), some).count() == 0
    assert impact_index.search(impact_index.build_index(some), none).count() == 0
    assert impact_index.search(impact_index.build_index(some.withColumn("text", F.lit("..."))), some).count() == 0


def test_slices_add_and_rank_like_numbers():
    rng = np.random.default_rng(2)
    for _ in range(30):
        size, total, plain = int(rng.integers(1, 200)), [], 0
        plain = np.zeros(size, np.int64)
        for _ in range(int(rng.integers(0, 6))):
            places = rng.choice(size, int(rng.integers(1, size + 1)), replace=False)
            values, shift = rng.integers(0, int(rng.choice([2, 9, 2**35])), len(places)), int(rng.integers(0, 4))
            impact_index.add(total, impact_index.slices_of(places, values, size), shift)
            plain[places] += values << shift
        k = int(rng.integers(1, 25))
        best = np.lexsort((np.arange(size), -plain))[:k]
        assert impact_index.top(total, k) == [(int(p), int(plain[p])) for p in best if plain[p] > 0]


@pytest.mark.parametrize("scale", [1.0, 1e200])
def test_nearest_neighbours_across_many_cells(spark, monkeypatch, scale):
    """Cells and packs of a few rows: brute force again, in clusters and out of them."""
    from quern.llm import additive_ann

    monkeypatch.setattr(additive_ann, "BLOCK_BYTES", 1 << 13)
    monkeypatch.setattr(additive_ann, "QUERY_ROWS", 8)
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(9, 16))
    x = np.concatenate([centres[rng.integers(0, 9, 500)] + 0.05 * rng.normal(size=(500, 16)), rng.normal(size=(300, 16)), np.repeat(centres[:1], 40, 0)]) * scale
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in additive_ann.nearest(frame, F.col("vec_id") % 7 == 0, k=6, candidates=12, codebooks=4, codewords=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(range(0, len(x), 7))
    for q, found in got.items():
        with np.errstate(all="ignore"):
            s = np.zeros(len(x))
            for d in range(16):
                s += x[q, d] * x[:, d]
        order = [i for i in np.lexsort((np.arange(len(x)), -s, np.isnan(s))) if i != q][:6]
        assert [found[k + 1][0] for k in range(6)] == order
        assert all(found[k + 1][1] == s[i] or s[i] != s[i] for k, i in enumerate(order))


def test_packs_pass_over_cells_that_cannot_help():
    from quern.llm import additive_ann

    import pyarrow as pa

    centres = np.array([[10.0, 0.0], [0.0, 10.0], [9.0, 1.0], [-10.0, 0.0]])
    queries, least = np.array([[1.0, 0.0], [2.0, 0.1]]), np.array([8.0, 17.0])
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b"q"]), pa.array([queries.tobytes()]), pa.array([least.tobytes()])], ["own", "queries", "vectors", "least"])
    met = [c for out in additive_ann._reachable(centres, np.array([1.0, 1.0, 1.0, -np.inf]))([batch]) for c in out.column(0).to_pylist()]
    assert met == [2]
