"""The operators of llm against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import additive_ann, line_dedup, minhash, ordinal_quality, packing, pii, quality_rules, sentencepiece_codec, substring_dedup, url_filter
from quern.llm.components import components
from quern.llm.queries import piece_model
from quern.llm.words import chunked_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, key string, n long"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus():
    """(doc_id, text) with copies, near copies, shared passages, blanks, nulls, repeats, a long text."""
    rng = random.Random(4)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    base = text(120)
    docs = [(0, base), (1, base), (2, base + "\nan extra line of words"), (3, fold(base))]
    for i in range(12):
        words = base.split()
        words[rng.randrange(120)] = f"changed{i}"
        docs.append((10 + i, " ".join(words)))
    docs += [(30, text(50) + "\n" + passage), (31, passage + "\n" + text(50)), (32, text(10) + " " + passage + " " + text(10) + " " + passage)]
    docs += [(40, ""), (41, None), (42, " \t\n "), (43, "one two"), (44, "One two"), (45, "three"), (46, "\x0b\x0c"), (47, "the same line here\nthe same line here\n\nThe Same Line Here  ")]
    docs += [(48, " the same line here"), (49, text(6000)), (50, "日本語 テキスト 😀 " * 30), (51, "mail a@b.com, 1.2.3.4 or +1 (234) 555-1234; 4111 1111 1111 1111"), (51, "mail a@b.com, 1.2.3.4 or +1 (234) 555-1234; 4111 1111 1111 1111")]
    docs += [(60 + i, f"Marlowe{i % 2} Quixote writes {chr(97 + i) * 5} from jane@x.org about {chr(107 + i) * 5}") for i in range(8)] + [(80, "Quixote alone"), (None, base)]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, "en", f"s{(d or 0) % 3}" if d != 45 else None, len(t or ""), 7, 8, "k", 9) for d, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_the_pattern():
    texts = ["", "a", " a  b\tc\x0bd ", None, "é ü\n", "x" * 5000 + " y"]
    counts = [n for _, _, w in chunked_words(pa.array(texts), limit=8) for n in np.diff(w.bounds).tolist()]
    assert counts == [len(WORD.findall(t or "")) for t in texts]
    hashes = [h for _, _, w in chunked_words(pa.array(["Ab cD", "aB Cd"]), fold=True) for h in w.hashes.tolist()]
    assert hashes[:2] == hashes[2:]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 200)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


def brute_components(rows, k, percent):
    sets = defaultdict(list)
    for d, t in rows:
        w = WORD.findall(fold(t or ""))
        s = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        sets[d].append(s)
    parent = {d: d for d in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sets, {d: find(d) for d in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    sets, root = brute_components(corpus(), k, 80)
    for r in minhash.near_duplicates(docs, shingle_words=k).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
            continue
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id][0]), root[r.doc_id], root[r.doc_id] == r.doc_id)


def test_near_duplicates_links_mixed_buckets(spark):
    """A chain of texts of which neighbours alone are similar enough: all of it is one component."""
    rng = random.Random(1)
    words = [f"x{i}" for i in range(200)]
    rows = []
    for d in range(20):
        rows.append((d, " ".join(words)))
        for _ in range(3):
            words[rng.randrange(200)] = f"y{rng.random()}"
    _, root = brute_components(rows, 4, 80)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()}
    assert got == root


def test_near_duplicates_of_ids_that_own_several_texts(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"n{rng.randrange(10_000)}" for _ in range(40))
    one, two, three, four = text(), text(), text(), text()
    rows = [(3, one), (5, one), (5, two), (7, two), (9, ""), (9, two), (11, three), (11, four), (12, three), (13, four + " more"), (1, ""), (15, None), (20, text())]
    sets, root = brute_components(rows, 4, 80)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=4).collect()
    assert len(got) == len(rows)
    assert all((r.component_id, r.kept) == (root[r.doc_id], root[r.doc_id] == r.doc_id) for r in got)
    assert root[9] == root[7] == 3 and root[13] == root[12] == 11


def test_keep_one_of_each_loses_no_text(spark, docs):
    """By rows, not by ids: what goes has a near copy that stays, in the group of texts that are linked."""
    rng = random.Random(13)
    text = lambda: " ".join(f"k{rng.randrange(10_000)}" for _ in range(40))
    one, two = text(), text()
    rows = [(3, one, "a"), (5, one, "b"), (5, two, "c"), (7, two, "d"), (8, two + " and", "e"), (3, one, "a"), (30, "", "f"), (30, "", "f"), (None, one, "g"), (31, None, "h"), (32, "b c", "i"), (33, "B c", "j")]
    kept = minhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, rep string"))
    assert kept.columns == ["doc_id", "text", "rep"]
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(3, one, "a"), (5, two, "c"), (30, "", "f"), (30, "", "f"), (None, one, "g"), (31, None, "h"), (32, "b c", "i")], key=repr)
    distinct = sorted({t for d, t in corpus() if d is not None and WORD.search(t or "")})
    _, root = brute_components(list(enumerate(distinct)), 5, 80)
    groups = defaultdict(set)
    for d, t in corpus():
        if d is not None and WORD.search(t or ""):
            groups[root[distinct.index(t)]].add((d, t))
    want = [min(g) for g in groups.values()]
    got = [(r.doc_id, r.text) for r in minhash.keep_one_of_each(docs).collect() if r.doc_id is not None and WORD.search(r.text or "")]
    assert sorted(r[0] for r in got) == sorted(r[0] for r in want) and len(got) == len(want)


def test_near_duplicates_of_nothing(empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert minhash.keep_one_of_each(empty).columns == empty.columns


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**64, 200, dtype=np.uint64)])
    agree = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(agree - 800 / 1200) < 0.12
    differing = sum(int(x).bit_count() for x in (minhash.sketch(a) ^ minhash.sketch(b)).view(np.uint64))
    assert abs(differing / 2048 - (1 - 800 / 1200) / 2) < 0.04


def test_url_rules_and_model(spark):
    rows = [(1, "http://a.example.com/en/7x"), (2, "http://EXAMPLE.com/en/8"), (3, "https://x.example.net/de/81#t"), (4, "http://b.net/de/?q"), (5, None), (6, "no scheme"), (7, "ftp://org"), (8, "http://c.org/es/1"), (9, "http://notcom/en/"), (10, "a://b://c/d"), (10, "a://b://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, None).collect()}
    assert (got[1].rule, got[1].verdict) == ("example.com/en/7", "allow")
    assert (got[2].host, got[2].rule, got[2].verdict) == ("example.com", "com/en/", "block")
    assert (got[3].path, got[3].rule, got[3].verdict) == ("/de/81", "example.net/de/8", "block")
    assert (got[4].rule, got[8].rule, got[9].rule) == ("net/de/", "org/es/", None)
    assert [(got[i].host, got[i].path) for i in (5, 6, 7, 10)] == [("", ""), ("", ""), ("org", ""), ("b:", "//c/d")]
    labelled = spark.createDataFrame([(f"http://{'spam' if i % 2 else 'good'}{i}.example/x{i}", i % 2) for i in range(200)], "url string, blocked int")
    weights = url_filter.fit_on(labelled, "url", "blocked")
    held = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'good'}{i}.example/z") for i in range(1000, 1100)], "page_id long, url string")
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in url_filter.judge_urls(held, weights).collect())
    assert url_filter.judge_urls(pages.where("false"), weights).count() == 0
    assert url_filter.fit_on(labelled.where("blocked = 1"), "url", "blocked") is None


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    covered = {j for p in grams.values() if len(p) > 1 for i in p for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_quality_rules(docs, empty):
    want = sorted(((d, *brute_measures(t)) for d, t in corpus()), key=repr)
    got = quality_rules.judge_documents(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=repr) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert quality_rules.judge_documents(empty).count() == 0


def test_bad_hosts_are_rejected(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", f"good{i % 5}") for i in range(200)] + [(1000 + i, good if i % 10 == 0 else "short", "bad") for i in range(100)] + [(2000, "short", "tiny")]
    got = quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r.kept for r in got if r.host.startswith("good") and not r.base_failed)
    assert not any(r.kept for r in got if r.host == "bad")
    rate = {r.host: r.host_rate for r in got}
    assert rate["tiny"] < 1.0 and rate["bad"] > 0.7


def test_ordinal_regression_orders_and_generalises(spark, empty):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(300)]

    def sample(i):
        grade = i % 3
        own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        own += [["insult", "slur"], ["***", "|||"], []][grade] * 2
        rng.shuffle(own)
        return i, " ".join(own), grade

    rows = [sample(i) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = ordinal_quality.fit_on(frame, frame.where("doc_id < 600").select("doc_id", "grade"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    scored = {r.doc_id: r for r in ordinal_quality.graded(frame.where("doc_id >= 600").select("doc_id", "text"), model).collect()}
    right = sum(scored[d].kept == (g == 2) for d, _, g in rows if d >= 600)
    assert right / 300 > 0.9
    assert all(r.p_above_lowest >= r.p_top for r in scored.values())
    kept = ordinal_quality.select_documents(frame, model)
    assert kept.columns == frame.columns and 0 < kept.count() < 900
    odd = spark.createDataFrame([(1, None), (None, ""), (1, "x" * 100_000)], "doc_id long, text string")
    assert ordinal_quality.graded(odd, model).count() == 3
    nothing = ordinal_quality.fit_on(empty, frame.select("doc_id", "grade").where("false"), 3)
    assert nothing.weights is None and ordinal_quality.graded(odd, nothing).where("kept").count() == 3
    assert ordinal_quality.graded(empty, model).count() == 0


def test_packing_places_every_token_once(docs, empty):
    bins = packing.pack(docs, capacities=(64, 128, 256), run_items=7).collect()
    seen = defaultdict(list)
    for b in bins:
        assert b.used == sum(b.lengths) <= b.capacity and b.capacity in (64, 128, 256) and b.n_pieces == len(b.doc_ids)
        assert b.capacity == min(c for c in (64, 128, 256) if c >= b.used)
        for d, s, n in zip(b.doc_ids, b.starts, b.lengths, strict=True):
            seen[d].append((s, n))
    totals = defaultdict(int)
    for d, t in corpus():
        totals[d] += len(WORD.findall(t or ""))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == {d: n for d, n in totals.items() if n}
    assert len({b.bin_id for b in bins}) == len(bins)
    assert packing.pack(empty).count() == 0


def test_packing_wastes_little():
    rng = random.Random(3)
    lengths = [min(4096, int(rng.expovariate(1 / 400)) + 1) for _ in range(5000)]
    bins = packing.pack_items(lengths)
    assert sorted(i for _, items in bins for i in items) == list(range(5000))
    assert sum(lengths) / sum(c for c, _ in bins) > 0.99


def test_codec_equals_the_library(docs, empty):
    import sentencepiece

    path = piece_model()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = [t for _, t in corpus()] + ["▁x", "<s> <0x0A>", "a\x00b", "   ", "a    b ", "x" * 1500, "日本" * 500] + ["".join(rng.choice("abe ▁\t\né日😀.") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    codec = sentencepiece_codec.Codec(open(path, "rb").read())
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    back = codec.decode(ids, bounds)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert ids[bounds[i] : bounds[i + 1]].tolist() == want
        assert back[i].decode() == library.decode(want)
    want = sorted((d, len(x := library.encode(t or "", add_bos=True, add_eos=True)), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(x).encode()).hexdigest()) for d, t in corpus() if d is not None)
    got = sentencepiece_codec.round_trip_digest(docs, path).where("doc_id is not null").collect()
    assert sorted(tuple(r) for r in got) == want
    encoded = sentencepiece_codec.encode(docs.where("doc_id = 51"), path)
    assert sentencepiece_codec.decode(encoded, path).first().text.startswith("mail a@b.com")
    assert sentencepiece_codec.round_trip_digest(empty, path).count() == 0


def brute_substrings(rows, size):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - size + 1):
            if d is not None and first[tuple(w[i : i + size])] < (d, i):
                gone |= set(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_substring_dedup(docs, empty):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(corpus(), 20)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def check_spans(spark, rows):
    """Spans are earlier texts word for word, cover what brute force removes, and are joined where they adjoin."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    covered, spans = defaultdict(set), defaultdict(list)
    for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.length >= 20 and (r.source_id, r.source_start) < (r.doc_id, r.start)
        assert words[r.doc_id][r.start : r.start + r.length] == words[r.source_id][r.source_start : r.source_start + r.length]
        covered[r.doc_id] |= set(range(r.start, r.start + r.length))
        spans[r.doc_id, r.source_id, r.source_start - r.start].append((r.start, r.start + r.length))
    assert {d: len(c) for d, c in covered.items()} == {d: n for d, _, n, _ in brute_substrings(rows, 20) if n}
    for of_one in spans.values():
        of_one.sort()
        assert all(b0 > a1 - 19 for (_, a1), (b0, _) in zip(of_one, of_one[1:], strict=False))
    return spans


def test_repeated_spans(spark):
    rng = random.Random(16)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    passage, twice = text(90), text(25)
    rows = [(1, text(30) + passage + text(10)), (2, passage), (3, text(7) + passage[10:70] + text(9) + twice + text(3) + twice), (4, text(50) + passage[:19])]
    spans = check_spans(spark, [(d, " ".join(w)) for d, w in rows])
    assert dict(spans) == {(2, 1, 30): [(0, 90)], (3, 1, 33): [(7, 67)], (3, 3, -28): [(104, 129)]}


def test_substring_dedup_of_overlapping_repeats(spark):
    """Pieces of one long text in random order, so that repeats begin and end anywhere."""
    rng = random.Random(6)
    source = [f"w{i % 90}" for i in range(400)]
    rows = []
    for d in range(40):
        own = []
        for _ in range(rng.randint(1, 5)):
            a = rng.randrange(380)
            own += source[a : a + rng.randint(5, 60)] + [f"z{rng.randrange(5)}"] * rng.randint(0, 30)
        rows.append((d, " ".join(own)))
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(rows, 20)
    check_spans(spark, rows)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[200:260] = x[100]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(5000, None, "a"), (5001, [0.0] * 32, "a"), (5002, [float("nan")] * 32, "a"), (5003, [1.0], "a"), (5004, [None] + [1.0] * 31, "a"), (100, x[100].tolist(), "again"), (None, x[3].tolist(), "a")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = additive_ann.nearest(frame, F.col("vec_id") % 20 == 0, k=10, codebooks=8, codewords=64).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append(r)
    hits = total = 0
    y = x.astype(float)
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:10]
        assert [r.rank for r in found[q]] == list(range(1, 11))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found[q])
        hits += len(set(want.tolist()) & {r.vec_id for r in found[q]})
        total += 10
    assert set(found) == set(range(0, 1500, 20)) and hits / total >= 0.9
    assert [r.vec_id for r in found[100]][:9] == list(range(200, 209))
    few = additive_ann.nearest(frame.where("vec_id < 3"), F.col("vec_id") == 0, k=10, codebooks=2, codewords=4).collect()
    assert len(few) == 2
    assert additive_ann.nearest(frame.where("vec_id = 5003"), F.lit(True)).count() == 0
    assert additive_ann.nearest(frame.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e200, 1e-200, 1e-160])
def test_nearest_neighbours_of_any_size_and_length(spark, scale):
    """Sizes beyond single precision, products that overflow or vanish, two lengths: always what brute force gives."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(300, 16)) * scale
    x[5] = x[6]
    y = rng.normal(size=(40, 4)) * scale
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v.tolist()) for i, v in enumerate(y)]
    got = defaultdict(list)
    for r in additive_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=7, candidates=10, codebooks=4, codewords=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for base, z in ((0, x), (1000, y)):
        for q in range(0, len(z), 20):
            with np.errstate(all="ignore"):
                s = np.zeros(len(z))
                for d in range(z.shape[1]):
                    s += z[q, d] * z[:, d]
            order = [i for i in np.lexsort((np.arange(len(z)), -s, np.isnan(s))) if i != q][:7]
            assert [v for v, _ in got[base + q]] == [base + i for i in order]
            assert all(a == s[i] or (a != a and s[i] != s[i]) for (_, a), i in zip(got[base + q], order, strict=True))


def test_nearest_neighbours_in_a_large_group_of_near_copies(spark):
    """More near-equal vectors than candidates: the codes cannot order them, the error bound keeps them all."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[:1500] = x[0] + 0.01 * rng.normal(size=(1500, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in additive_ann.nearest(frame, F.col("vec_id") % 100 == 0, k=10, candidates=40, codebooks=4, codewords=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    y = x.astype(float)
    for q in range(0, 3000, 100):
        s = y @ y[q]
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(3000), -s))[:10].tolist()


def brute_lines(rows, least=10):
    spaces = " \t\n\x0b\x0c\r"
    key = lambda x: fold(x.strip(spaces))
    owners = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= least:
                owners[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches", [1, 7])
def test_line_dedup(docs, empty, batches):
    got = line_dedup.dedup_lines(docs, batches=batches).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_lines(corpus())
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.strip_lines(docs).columns == docs.columns


def test_line_runs_take_later_batches_and_compact(spark):
    rows = [(i, f"a line of batch {i % 3} shared\nown line number {i}") for i in range(40)]
    runs = line_dedup.LineRuns(spark, fanout=2)
    out = []
    for i in range(0, 40, 10):
        out += line_dedup.dedup_lines(spark.createDataFrame(rows[i : i + 10], "doc_id long, text string"), batches=1, runs=runs).collect()
    assert len(runs.runs()) < 4
    runs.close()
    assert sorted((tuple(r) for r in out), key=repr) == brute_lines(rows)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute_pii(text):
    def passes(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in value.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group()))


def test_pii_base_spans(spark, docs, empty):
    rng = random.Random(8)
    texts = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.4", "x" * 5000 + "@a.b", "1" * 20_000, "a@b..c", "+12345678+12345678", "é😀 me@x.yz"] + ["".join(rng.choice("ab1.@-_%+ 0123456789()é😀\n") for _ in range(rng.randint(1, 120))) for _ in range(800)]
    got = {r.doc_id: r.base for r in pii.pii_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != brute_pii(t)] == []
    report = pii.pii_report(docs).collect()
    assert sorted(r.base for r in report) == sorted(brute_pii(t) for _, t in corpus())
    assert pii.pii_report(empty).count() == 0


def test_terms_that_give_an_entity_away(docs):
    report = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    text = dict(corpus())[60]
    marked = [tuple(map(int, s.split(":")[1:])) for s in report[60].spans.split(",") if s.startswith("term")]
    assert "Quixote" in {text[a:b] for a, b in marked}
    assert report[80].spans == "term:0:7" and report[43].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "jane@x.org" not in clean[60] and "Quixote" not in clean[60] and "<EMAIL>" in clean[60]
    assert clean[43] == "one two" and clean[41] is None
    assert clean[51] == "mail <EMAIL>, <IP> or <PHONE>; <CARD>"
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()


def word_of(i):
    return "".join(chr(97 + (i // 26**k) % 26) for k in range(4))


def marked_words(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in pii.pii_report(rows).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s.startswith("term")]
        out[r.doc_id] = {texts[r.doc_id][int(a) : int(b)] for _, a, b in spans}
    return out


def test_terms_of_values_that_are_seen_once_or_twice(spark):
    """Unique addresses share a domain; a value in two texts; a name that the address is made of; a signature with the same words around it."""
    clean = [f"plain {word_of(i)} words" for i in range(60)]
    texts = [f"{word_of(100 + i)} asks Zorblatt at u{i}@acme.example for {word_of(200 + i)}" for i in range(12)]
    texts += [f"{word_of(300 + i)} then Quillfeather 9.8.7.6 {word_of(400 + i)}" for i in range(2)]
    texts += ["Brambleby writes from brambleby@else.example", "mail one@lone.example or more"]
    signature = "\n-- -- -- -- -- --\nHartwhistle Lane office, +44 20 7946 0958"
    texts += [f"{word_of(500 + i)} {'. ' * 40}{signature}" for i in range(5)]
    got = marked_words(spark, clean + texts)
    assert all("Zorblatt" in got[60 + i] for i in range(12))
    assert all(got[72 + i] >= {"Quillfeather"} for i in range(2))
    assert "Brambleby" in got[74] and got[75] == set()
    assert all({"Hartwhistle", "Lane"} <= got[76 + i] for i in range(5))
    assert not any(got[i] for i in range(60))
    copied = marked_words(spark, clean + ["mail one@lone.example or more"] * 5)
    assert not any(copied.values())


def test_terms_far_from_the_values(spark):
    """A name in the first line and the address at the end; an address's own words are not terms of the text."""
    clean = [f"plain {word_of(i)} words" for i in range(60)]
    filler = lambda i: " ".join(word_of(1000 + 20 * i + j) for j in range(20))
    texts = [f"Wetherspool\n{filler(i)}\nw.w@acme.example" for i in range(6)] + ["example of a plain text"]
    texts += [f"Ottoline {filler(10 + i)} 7.7.7.7" for i in range(4)] + [f"Ottoline at 7.7.7.7 {word_of(900 + i)}" for i in range(2)]
    got = marked_words(spark, clean + texts)
    assert all("Wetherspool" in got[60 + i] for i in range(6))
    assert got[66] == set()
    assert all("Ottoline" in got[67 + i] for i in range(6))
    assert not any(got[i] for i in range(60))


def brute_terms(texts):
    """{term: action} by the definition, text by text."""
    import math

    import regex

    tokens = lambda t: {w.lower() for w in regex.findall(r"\p{L}{4,}", t)}
    digits = lambda v: re.sub("[^0-9]", "", v)
    group = {"email": lambda v: v.split("@")[-1], "ip": lambda v: v.rsplit(".", 1)[0], "card": lambda v: digits(v)[:6], "phone": lambda v: digits(v)[:-4]}
    n_term, n_entity, n_both, near, beside = defaultdict(int), defaultdict(int), defaultdict(int), set(), defaultdict(set)
    distinct = sorted(set(texts))
    for t in distinct:
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_pii(t).split(",") if x))
        outside, at = "", 0
        for a, b, _ in spans:
            if a >= at:
                outside += t[at:a] + "|"
            at = max(at, b)
        terms = tokens(outside + t[at:])
        entities = set()
        for a, b, kind in spans:
            value = t[a:b].lower()
            entities |= {(0, kind, value), (1, kind, group[kind](value)), (2, kind, "")}
            left, right = t[max(0, a - 64) : a], t[b : b + 64]
            left = re.sub(r"^\S*", "", left) if a > 64 else left
            right = re.sub(r"\S*$", "", right) if b + 64 <= len(t) else right
            beside[t, kind, value] |= tokens(left + " | " + right)
        for w in terms:
            n_term[w] += 1
        for e in entities:
            n_entity[e] += 1
            for w in terms:
                n_both[e, w] += 1
                if e[0] == 0 and w in beside[t, e[1], e[2]]:
                    near.add((e, w))
    total, best = max(2, len(distinct)), defaultdict(float)
    for (e, w), both in n_both.items():
        own, all_ = n_entity[e], n_term[w]
        rare = e[0] == 0 and own < 3
        if rare and (both < own or (e, w) not in near or (own == 1 and w not in tokens(e[2])) or both / all_ < 0.5):
            continue
        share, chance = both / all_, own / total
        if not rare and both < 3 or share < 0.25:
            continue
        mutual = math.log2(share / chance)
        others = (all_ - both) * math.log2((1 - share) / (1 - chance)) if share < 1 else 0
        if e[0] > 0 and not (share > chance and both * mutual + others >= 20):
            continue
        best[w] = max(best[w], mutual / math.log2(max(2, total / own)))
    return {w: "gone" if x >= 0.9 else "term" for w, x in best.items() if x >= 0.7}


def test_disclosing_terms_equal_brute_force(spark):
    import regex

    rng = random.Random(21)
    names, plain = [word_of(7000 + i).title() for i in range(14)], [word_of(8000 + i) for i in range(120)]
    texts = []
    for i in range(260):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 30))]
        if i % 3 == 0:
            k = rng.randrange(12)
            value = [f"{names[k].lower()}@site{k % 3}.example", f"10.0.{k}.{rng.randrange(9)}", f"+44 20 7946 0{k:03d}"][k % 3]
            words.insert(rng.randrange(len(words) + 1), value)
            words.insert(rng.randrange(len(words) + 1), names[k])
        if i % 5 == 1:
            words.append(names[rng.randrange(14)])
        texts.append(" ".join(words))
    texts += texts[:9] + ["", "Solo writes solo@one.example"]
    want = brute_terms(texts)
    assert {"gone", "term"} <= set(want.values())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, found = pii.find_base(frame, "doc_id", "text")
    assert {r.term: r.action for r in pii.disclosing_terms(own, found).collect()} == want
    for r in pii.pii_report(frame).collect():
        t, base = texts[r.doc_id], [tuple(map(int, x.split(":")[1:])) for x in brute_pii(texts[r.doc_id]).split(",") if x]
        places = [m.span() for m in regex.finditer(r"\p{L}+", t) if m.group().lower() in want and not any(a < m.end() and m.start() < b for a, b in base)]
        assert [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")] == places


def test_pii_of_a_text_with_very_many_matches(spark):
    import time

    text = " ".join(f"name{i} u{i}@d{i % 7}.example" for i in range(8000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    report = pii.pii_report(frame).first()
    assert report.n_email == 8000 and report.base == brute_pii(text)
    assert pii.sanitise(frame).first().text == " ".join(f"name{i} <EMAIL>" for i in range(8000))
    assert time.time() - began < 60


def test_a_term_that_leaves_the_entity_open_is_kept(spark):
    """A name in three texts with the address and in thirty without it gives little away, however large the corpus."""
    texts = [f"Weatherby mails w@acme.example on {word_of(20 + i)}" for i in range(3)] + [f"Weatherby alone {word_of(50 + i)}" for i in range(30)]
    texts += [f"plain {word_of(100 + i)} words" for i in range(900)]
    got = marked_words(spark, texts)
    assert not any("Weatherby" in marked for marked in got.values())
    assert got[0] >= {"mails"}
