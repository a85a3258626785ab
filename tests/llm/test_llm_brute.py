"""Models, packing and the pipeline against plain versions written here, and every stage on awkward tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from test_llm_operators import SCHEMA, WORD, brute_components, brute_lines, brute_pii, brute_terms, corpus

import corpus_pipeline
from quern.llm import ordinal_quality, packing, pii, url_filter
from quern.llm.hashed_text import Features, char_ngrams, word_features
from quern.llm.words import chunked_words


# --- urls -------------------------------------------------------------------------------

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def plain_url(url):
    """(host, path, rule, verdict of the rule) by cutting the url by hand."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = re.split("[?#]", rest, maxsplit=1)[0]
    best = None
    for rule in RULES:
        own, at = rule[: rule.index("/")], rule[rule.index("/") :]
        if (host == own or host.endswith("." + own)) and path.startswith(at) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best, RULES.get(best)


def test_url_rules_equal_plain_ones(spark):
    rng = random.Random(31)
    hosts = ["example.com", "a.example.com", "notexample.com", "com", "x.com", "Example.NET", "b.example.net", "net", "y.org", "org", "z.info", ""]
    paths = ["/en/", "/en/7", "/en/78/x", "/en", "/de/8", "/de/9", "/es/1", "/EN/1", "", "?q=/en/", "#/en/", "/es/?u=http://k.com/en/"]
    urls = [rng.choice(["http", "HTTPS", "a"]) + "://" + rng.choice(hosts) + rng.choice(paths) for _ in range(400)] + [None, "", "://", "no scheme/en/", "http:/x.com/en/", "a\nb://x.com/en/1", "x://é.com/en/ü"]
    frame = spark.createDataFrame([(i if i % 9 else None, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(frame, None).collect())
    want = Counter()
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_url(u)
        want[i if i % 9 else None, host, path, rule, verdict or "allow"] += 1
    assert got == want


def grams_of(*fields):
    out = set()
    for n, text in enumerate(fields):
        data = b"\x02" + text.encode() + b"\x03"
        out |= {(n, data[i : i + k]) for k in (3, 4, 5) for i in range(len(data) - k + 1)}
    return out


def test_ngrams_and_their_regression_equal_plain_ones():
    rng = random.Random(32)
    rows = [("".join(rng.choice("ab.cd") for _ in range(rng.randint(0, 9))), "/" * (i % 2) + "".join(rng.choice("xyé") for _ in range(i % 7))) for i in range(120)]
    made = char_ngrams([pa.array([h for h, _ in rows]), pa.array([p for _, p in rows])], 3, 5, 20)
    sets = [grams_of(*r) for r in rows]
    assert np.bincount(made.rows, minlength=120).tolist() == [len(s) for s in sets]
    assert all(abs(v - 1 / math.sqrt(len(sets[r]))) < 1e-6 for r, v in zip(made.rows.tolist(), made.values.tolist(), strict=True))
    dense = np.zeros((120, 1 << 20), np.float32)
    dense[made.rows, made.buckets] = made.values
    near = dense @ dense.T
    off = [abs(near[i, j] - len(sets[i] & sets[j]) / math.sqrt(max(1, len(sets[i]) * len(sets[j])))) > 1e-5 for i in range(120) for j in range(120)]
    assert sum(off) < 0.02 * len(off)  # n-grams that share a bucket
    # The same descent over named features gives the same probabilities.
    blocked = np.array([int("ab" in h) for h, _ in rows])
    weights = url_filter.fit(pa.array([h for h, _ in rows]), pa.array([p for _, p in rows]), blocked)
    names = {g: i for i, g in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((120, len(names) + 1))
    for r, s in enumerate(sets):
        for g in s:
            x[r, names[g]] = 1 / math.sqrt(len(s))
    x[:, -1] = 1
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, url_filter.STEPS + 1):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - blocked) / 120 + url_filter.L2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= url_filter.RATE * (1 - (t - 1) / url_filter.STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    small = char_ngrams([pa.array([h for h, _ in rows]), pa.array([p for _, p in rows])], 3, 5, url_filter.BITS)
    p = 1 / (1 + np.exp(-(small.scores(weights[:-1]) + weights[-1])))
    assert np.abs(p - 1 / (1 + np.exp(-x @ w))).max() < 0.02


# --- ordinal regression -----------------------------------------------------------------


def test_ordinal_likelihood_and_gradient_equal_plain_ones():
    rng = np.random.default_rng(33)
    n, size, grades = 40, 12, 4
    dense = rng.normal(size=(n, size)) * (rng.random((n, size)) < 0.4)
    rows, buckets = np.nonzero(dense)
    x = Features(rows, buckets, dense[rows, buckets], n)
    grade = rng.integers(0, grades, n)

    def plain(w):
        theta = [w[size]]
        for z in w[size + 1 :]:
            theta.append(theta[-1] + math.exp(z))
        total = 0.0
        for i in range(n):
            tail = lambda k: 1.0 if k == 0 else 0.0 if k == grades else 1 / (1 + math.exp(-(dense[i] @ w[:size] - theta[k - 1])))
            total -= math.log(tail(grade[i]) - tail(grade[i] + 1))
        return total / n + ordinal_quality.L2 / 2 * (w[:size] ** 2).sum()

    w = np.append(rng.normal(size=size) * 0.3, [-0.7, 0.1, -0.2])
    value, gradient = ordinal_quality.likelihood(w, x, grade, grades)
    assert abs(value - plain(w)) < 1e-9
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        assert abs(gradient[i] - (plain(w + step) - plain(w - step)) / 2e-6) < 1e-6


def test_grades_are_those_of_single_texts(spark):
    """Batches, chunks and long texts change nothing; columns that clash pass through."""
    rng = random.Random(34)
    texts = [" ".join(rng.choice(["fine", "words", "***", "slur", "|||", "and", "more"]) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "long " * 300_000]
    rows = [(i if i % 11 else None, t, [1.5], i % 3) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, grades array<double>, grade int")
    ratings = frame.where("doc_id < 120").select("doc_id", "grade")
    model = ordinal_quality.fit_on(frame, ratings, 3)
    assert ordinal_quality.fit_on(frame.union(frame), ratings, 3).thresholds.tolist() == pytest.approx(model.thresholds.tolist(), abs=1e-5)
    single = []
    for t in texts:
        ((_, _, words),) = chunked_words(pa.array([t or ""]))
        single.append(model.tails(word_features(words, ordinal_quality.BITS))[0])
    kept = Counter((r.doc_id, r.text, tuple(r.grades), r.grade) for r in ordinal_quality.select_documents(frame, model).collect())
    assert kept == Counter((d, t, (1.5,), g) for (d, t, _, g), p in zip(rows, single, strict=True) if p[-1] >= 0.5)
    got = sorted((r.expected_grade, r.p_above_lowest, r.p_top) for r in ordinal_quality.graded(frame, model).collect())
    assert np.allclose(got, sorted((round(p.sum(), 6), round(p[0], 6), round(p[1], 6)) for p in single), atol=2e-6)


# --- packing ----------------------------------------------------------------------------


def plain_pack(lengths, capacities, cost):
    """Best fit by looking at every open bin; of bins with equal room the one that got it last."""
    bins, clock = [], 0
    waiting = sum(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        clock += 1
        waiting -= lengths[i]
        fitting = [b for b in bins if b["room"] >= lengths[i]]
        if fitting:
            own = min(fitting, key=lambda b: (b["room"], -b["since"]))
        else:
            size = min((c for c in capacities if c >= lengths[i]), key=lambda c: (cost(c) / (lengths[i] + min(c - lengths[i], waiting)), c))
            own = {"room": size, "items": [], "used": 0}
            bins.append(own)
        own["items"].append(i)
        own["used"] += lengths[i]
        own["room"] -= lengths[i]
        own["since"] = clock
    return [(min(c for c in capacities if c >= b["used"]), b["items"]) for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_plain_best_fit(seed):
    rng = random.Random(seed)
    capacities = [(16, 32, 64), (100,), (8, 512)][seed % 3]
    lengths = [rng.randint(1, max(capacities)) if rng.random() < 0.3 else rng.randint(1, max(capacities) // 6 + 1) for _ in range(rng.randint(0, 400))]
    assert packing.pack_items(lengths, capacities) == plain_pack(lengths, capacities, packing.sequence_cost)


def test_small_partitions_are_packed_together(spark):
    rng = random.Random(36)
    rows = [(i, "w " * rng.randint(1, 300)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(80)
    fill = lambda bins: sum(b.used for b in bins) / sum(b.capacity for b in bins)
    together = packing.pack(frame).collect()
    assert fill(together) > 0.98 and sum(b.used for b in together) == sum(len(t.split()) for _, t in rows)
    runs = packing.pack(frame, run_items=50)
    assert 4 < runs.rdd.getNumPartitions() <= 8 and fill(runs.collect()) < fill(together)


# --- the pipeline -----------------------------------------------------------------------


def plain_sanitised(texts):
    """Texts with base spans replaced and disclosing terms generalised or removed, by hand."""
    terms = brute_terms([t or "" for t in texts])
    out = []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        base = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in brute_pii(t).split(",") if x)]
        own = [(*m.span(), terms[m.group().lower()]) for m in regex.finditer(r"\p{L}+", t) if m.group().lower() in terms]
        own = [(a, b, k) for a, b, k in own if not any(x < b and a < y for x, y, _ in base)]
        done, at = "", 0
        for a, b, k in sorted(base + own, key=lambda s: (s[0], -s[1])):
            if a >= at:
                done += t[at:a] + pii.PLACEHOLDERS[k]
            at = max(at, b)
        out.append(done + t[at:])
    return out


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with ``documents`` and ``labels``: awkward rows, and toxic and good ones to learn from."""
    folder = f"file://{tmp_path_factory.mktemp('small')}"
    rng = random.Random(35)
    words = [f"t{i}" for i in range(300)]
    graded = []
    for i in range(300):
        own = [rng.choice(words) for _ in range(rng.randint(30, 60))] + [["insult", "slur"], ["***", "|||"], []][i % 3] * 2
        rng.shuffle(own)
        graded.append((1000 + i, " ".join(own)))
    rows = corpus() + graded + [(3, corpus()[0][1]), (1002, graded[5][1]), (None, None), (None, "")]
    spark.createDataFrame([(d, t, "en", f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, int(i % 3 == 2), int(i % 3 == 0)) for i, (d, _) in enumerate(graded)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stages_equal_plain_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    key = lambda rows: sorted(rows, key=repr)
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, df: corpus_pipeline.materialize(stages[name](spark, df, small), name)

    chosen = step("quality_classifier", docs)
    model = ordinal_quality.fit_on(docs, ordinal_quality.grade_of_labels(spark.read.parquet(f"{small}/labels.parquet")), 3)
    good = []
    for d, t in plain(docs):
        ((_, _, words),) = chunked_words(pa.array([t or ""]))
        if model.tails(word_features(words, ordinal_quality.BITS))[0][-1] >= 0.5:
            good.append((d, t))
    assert key(plain(chosen)) == key(good) and 100 < len(good) < docs.count()

    lines = step("line_dedup", chosen)
    assert key((d, t or "") for d, t in plain(lines)) == key((d, t) for d, _, _, t in brute_lines(good))
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.text is not None)

    single = step("minhash_dedup", lines)
    before = plain(lines)
    taking = [(d, t) for d, t in before if d is not None and WORD.search(t or "")]
    distinct = sorted({t for _, t in taking})
    _, root = brute_components(list(enumerate(distinct)), 5, 80)
    groups = defaultdict(list)
    for d, t in taking:
        groups[root[distinct.index(t)]].append(d)
    kept = [(d, t) for d, t in plain(single) if d is not None and WORD.search(t or "")]
    assert sorted(d for d, _ in kept) == sorted(min(g) for g in groups.values())
    assert len({root[distinct.index(t)] for _, t in kept}) == len(kept) == len(groups)
    rest = lambda rows: key(r for r in rows if r[0] is None or not WORD.search(r[1] or ""))
    assert rest(plain(single)) == rest(before)

    clean = step("pii", single)
    ids, texts = zip(*plain(single), strict=True)
    assert key(plain(clean)) == key(zip(ids, plain_sanitised(texts), strict=True))

    one = clean.coalesce(1)
    bins = stages["best_fit_packing"](spark, one, small).collect()
    pieces = [(r.doc_id, s, min(4096, n - s)) for r in one.collect() for n in [len(WORD.findall(r.text or ""))] for s in range(0, n, 4096)]
    want = plain_pack([p[2] for p in pieces], packing.CAPACITIES, packing.sequence_cost)
    assert [(b.capacity, list(zip(b.doc_ids, b.starts, b.lengths, strict=True))) for b in bins] == [(c, [pieces[i] for i in items]) for c, items in want]

    whole = corpus_pipeline.run(spark, small)
    assert sum(r.used for r in whole.collect()) == sum(p[2] for p in pieces)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, small, name):
    """Empty tables, null and repeated ids, null, blank and very long texts, columns whose names clash."""
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, key string, grades array<double>, component_id long, spans string, length int, label int"
    fill = lambda d, t: (d, t, None, None, None, 1, 2, "k", [0.5], 3, "s", 4, 5)
    rows = [fill(d, t) for d, t in [(1, None), (1, ""), (None, None), (None, "a b c"), (2, " \n "), (2, "same text here and there"), (2, "same text here and there"), (3, "same text here and there"), (4, "w " * 20_000 + "x@y.org"), (5, "日本語😀\x00"), (6, "one line that is long\n" * 50)]]
    table = spark.createDataFrame(rows, clash)
    out = stage(spark, table, small)
    count = out.count()
    if name == "best_fit_packing":
        assert sum(r.used for r in out.collect()) == sum(len(WORD.findall(r[1] or "")) for r in rows)
    else:
        assert out.columns == table.columns and count <= len(rows)
    if name in ("line_dedup", "pii"):
        assert count == len(rows)
    if name == "minhash_dedup":
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "1", "None", "None", "2", "2", "4", "5", "6"])
    nothing = stage(spark, spark.createDataFrame([], SCHEMA.replace(", id long, row long, key string, n long", "")), small)
    assert nothing.count() == 0
