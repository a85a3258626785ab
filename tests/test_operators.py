"""Sources, the SQL guard, chunking, upserts and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import history, models, quality, retrieval, sqlguard
from quern.sources import files, payloads
from quern.streaming import incremental


def test_payloads(spark):
    green = {"jobs": [{"absolute_url": "https://x/1", "title": "Data Scientist", "location": {"name": "Boston, MA"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "first_published": "2026-05-01T00:00:00Z", "pay_input_ranges": [{"min_cents": 10000000, "max_cents": 12000000, "currency_type": "USD", "interval": "annual"}]}, {"title": "no url"}]}
    lever = [{"text": "Engineer", "hostedUrl": "https://y/1", "categories": {"location": "Remote", "commitment": "Full-time"}, "createdAt": 1777593600000, "description": "Body", "lists": [{"text": "Do", "content": "this"}]}]
    ashby = {"jobs": [{"jobUrl": "https://z/1", "title": "Analyst", "isRemote": True, "secondaryLocations": '[{"location":"Toronto"}]', "compensation": {"compensationTiers": [{"components": [{"compensationType": "Equity"}, {"compensationType": "Salary", "compensationValue": {"minValue": 1.0, "maxValue": 2.0, "currencyCode": "CAD", "interval": "1 WEEK"}}]}]}}]}
    rows = [("a", "A", "greenhouse", json.dumps(green)), ("b", "B", "lever", json.dumps(lever)), ("c", "C", "ashby", json.dumps(ashby)), ("d", "D", "other", "{}"), ("e", "E", "lever", "{broken")]
    jobs, stats = payloads.extract_all(spark.createDataFrame(rows, "company_slug string, company_name string, provider string, payload string"))
    got = {r.company_slug: r for r in jobs.collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].salary_min, got["a"].salary_period, got["a"].description_md) == (100000.0, "year", "Hi")
    assert "## Do" in got["b"].description_md and got["b"].posted_at is not None
    assert (got["c"].location_raw, got["c"].salary_period, got["c"].salary_max) == ("Remote – Toronto", None, 2.0)
    errors = {r.company_slug: r.error for r in stats.collect()}
    assert errors["d"] == "unknown provider" and errors["e"] == "unreadable payload" and errors["a"] is None


@pytest.mark.parametrize("sql", ["DROP TABLE jobs", "SELECT * FROM secrets", "SELECT password FROM jobs", "", "INSERT INTO jobs VALUES (1)", "SELECT id FROM jobs WHERE id IN (SELECT x FROM other)", "SELECT java_method('java.lang.System', 'getProperty', 'user.dir') FROM jobs", "SELECT reflect('java.util.UUID', 'randomUUID') FROM jobs", "SELECT id FROM jobs WHERE upper(current_user()) = 'A'", "SELECT id FROM jobs UNION SELECT id FROM jobs", "SELECT id FROM jobs UNION ALL SELECT id FROM jobs ORDER BY id LIMIT 3", "SELECT id FROM jobs EXCEPT SELECT id FROM jobs", "SELECT id FROM jobs WHERE id = (SELECT max(reflect('a', 'b')) FROM jobs)", "SELECT ', secrets as (' AS y, title FROM secrets", "SELECT /* , secrets as ( */ title FROM secrets", "WITH secrets AS (SELECT title FROM secrets) SELECT title FROM secrets", "WITH t AS (SELECT id FROM u), u AS (SELECT id FROM jobs) SELECT id FROM t", "SELECT id FROM (WITH t AS (SELECT id FROM jobs) SELECT id FROM t) JOIN t USING (id)", "SELECT id FROM jobs WHERE EXISTS (WITH t AS (SELECT id FROM jobs) SELECT id FROM t) AND id IN (SELECT id FROM t)", "SELECT title FROM IDENTIFIER('secrets')", "SELECT IDENTIFIER('password') FROM jobs", "SELECT * FROM range(5)", "SELECT * FROM VALUES (1)", "TABLE secrets", "FROM secrets SELECT title", "SELECT id, (SELECT max(title) FROM secrets) AS m FROM jobs", "SELECT id FROM jobs, LATERAL (SELECT title FROM secrets)", "SELECT t FROM jobs LATERAL VIEW java_method('a', 'b') x AS t", "SELECT id FROM parquet.`/tmp/x`", "WITH RECURSIVE t AS (SELECT id FROM jobs UNION ALL SELECT id FROM t) SELECT id FROM t"])
def test_guard_rejects(spark, sql):
    with pytest.raises(sqlguard.UnsafeSql):
        sqlguard.validate(spark, sql, "jobs", ["id", "title"])


@pytest.mark.parametrize("sql", ["SELECT id FROM jobs;", "SELECT count(*) AS n FROM jobs GROUP BY title ORDER BY n", "WITH t AS (SELECT id FROM jobs) SELECT id FROM t", "SELECT j.id FROM jobs j WHERE title LIKE 'a%'", "SELECT DISTINCT upper(title) AS t, count(DISTINCT id) AS n FROM jobs GROUP BY title HAVING count(*) > 1", "SELECT id, row_number() OVER (PARTITION BY title ORDER BY id) AS r FROM jobs LIMIT 5 OFFSET 2", "SELECT CASE WHEN id > 1 THEN 'x' END AS c FROM (SELECT id FROM jobs)", "WITH t AS (SELECT id FROM jobs), u AS (SELECT id FROM t) SELECT T.id FROM t JOIN U USING (id) WHERE id IN (SELECT id FROM u)", "WITH t(n) AS (SELECT id FROM jobs) SELECT n FROM t", "SELECT ID FROM Jobs", "SELECT id FROM jobs WHERE id IN (WITH t AS (SELECT id FROM jobs) SELECT id FROM t)"])
def test_guard_accepts(spark, sql):
    assert sqlguard.validate(spark, sql, "jobs", ["id", "title"])


def test_guarded_execution_and_questions(spark):
    jobs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, secret string")
    assert sqlguard.execute(jobs, "SELECT * FROM jobs", ["id", "title"]).columns == ["id", "title"]
    good = sqlguard.ask(jobs, "how many?", lambda prompt: "```sql\nSELECT count(*) AS n FROM jobs\n```", ["id", "title"])
    assert good.rows[0].n == 2 and good.as_json() == [{"n": 2}]
    assert "not allowed" in sqlguard.ask(jobs, "?", lambda prompt: "DROP TABLE jobs", ["id"]).error
    assert sqlguard.ask(jobs, "?", None, ["id"]).error


def test_dense_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    x[50:90] = x[7]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "i long, v array<double>")
    got = {}
    for r in retrieval.dense_top_k(frame.where("i % 100 = 0 or i = 7"), frame, "i", "v", "i", "v", 12, F.col("i") < 250, own=False, query_rows=2, item_rows=64).collect():
        got[r.query, r.rank] = (r.item, r.score)
    for q in (0, 7, 100, 200):
        s = x @ x[q]
        s[[q, *range(250, 300)]] = -np.inf
        want = np.lexsort((np.arange(300), -np.round(s, 12)))[:12]
        assert [got[q, k + 1] for k in range(12)] == [(int(i), round(float(s[i]), 4)) for i in want]
    assert retrieval.dense_top_k(frame.where("false"), frame, "i", "v", "i", "v", 3).count() == 0


def test_splitter_and_chunks(spark):
    text = "\n## A\n" + "one two. " * 60 + "\n## B\n" + "x" * 300
    pieces = retrieval.split_text(text, 200, 20)
    assert all(0 < len(p) <= 200 for p in pieces) and "x" * 100 in "".join(pieces)
    docs = spark.createDataFrame([(1, "T", "body " * 600), (2, "E", " ")], "k int, title string, body string")
    rows = retrieval.chunk(docs, "k", "title", "body").collect()
    assert {r.k for r in rows} == {1} and len({r.child_chunk_id for r in rows}) == len(rows)


def test_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    files.write_snapshot(df, f"{root}/s", "2026-05-01")
    files.write_snapshot(df.withColumn("more", F.lit(1)), f"{root}/s", "2026-05-08")
    files.write_snapshot(df.limit(1), f"{root}/s", "2026-05-01")
    assert files.read_snapshots(spark, f"{root}/s", "2026-05-01").count() == 1 and files.latest_snapshot(spark, f"{root}/s").count() == 1
    files.write_snapshot(df, f"{root}/s", "2026-05-01")
    df.write.parquet(f"{root}/d/2026-05-01/jobs.parquet")
    assert [str(r.snapshot_date) for r in files.read_dated(spark, f"{root}/d").collect()] == ["2026-05-01"] * 2
    rows = files.read_snapshots(spark, f"{root}/s")
    assert {str(r.snapshot_date) for r in rows.collect()} == {"2026-05-01", "2026-05-08"}
    assert history.history(rows).count() == 2
    assert files.known_ids(spark, f"{root}/none").count() == 0
    (tmp_path / "q.jsonl").write_text('{"query_id": "1", "query": "x"}\nbroken\n\n{"query": "y"}\n')
    assert files.read_jsonl(spark, f"{root}/q.jsonl", "query_id string, query string", ("query_id",)).count() == 1
    assert "| id | v |" in files.report_markdown(df, "t") and json.loads(files.report_json(df))[0]["id"] == "a"


def test_validation_and_models(spark):
    rows = spark.createDataFrame([("x" * 16, "s", "t", "http://a", "lever"), ("bad", "s", "t", "ftp", "lever")], "id string, company_slug string, title string, url string, source string")
    checked = quality.violations(rows)
    assert quality.valid_rows(checked).count() == 1
    with pytest.raises(ValueError):
        quality.require_valid(checked)
    assert models.importances(["a", "b"], [0.1, -0.5])[0][0] == "b"


def test_stream_folds_each_file_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    for day in ("2026-05-01", "2026-05-08"):
        spark.sql(f"SELECT 'a' AS id, DATE '{day}' AS snapshot_date").coalesce(1).write.mode("append").parquet(f"{root}/in")
        incremental.fold_snapshots(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, f"{root}/state", f"{root}/cp")
    assert incremental.lineage(spark, f"{root}/state").first().times_seen == 2


def test_stream_state_is_compacted(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert incremental.lineage(spark, f"{root}/state") is None
    for i in range(7):
        spark.sql(f"SELECT explode(array('a', 'b{i}')) AS id, DATE '2026-05-0{i + 1}' AS snapshot_date").coalesce(1).write.mode("append").parquet(f"{root}/in")
        incremental.fold_snapshots(spark, f"{root}/in", spark.read.parquet(f"{root}/in").schema, f"{root}/state", f"{root}/cp", every=3)
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.is_dir()) == ["base=00000005", "delta=00000006"]
    rows = {r.id: (str(r.first_seen_at), str(r.last_seen_at), r.times_seen) for r in incremental.lineage(spark, f"{root}/state").collect()}
    assert rows["a"] == ("2026-05-01", "2026-05-07", 7) and len(rows) == 8 and rows["b2"] == ("2026-05-03", "2026-05-03", 1)
    incremental.compact(spark, f"{root}/state", 5)
    incremental.compact(spark, f"{root}/state", 5)
    assert incremental.lineage(spark, f"{root}/state").count() == 8


def test_registry_of_companies(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("companies:\n  - {slug: a, name: A, provider: lever, handle: aa}\n  - {slug: b, name: B, provider: other, handle: bb, default_country: CA}\n")
    rows = payloads.load_registry(spark, f"file://{tmp_path}/c.yaml")
    assert [(r.slug, r.default_country) for r in rows.orderBy("slug").collect()] == [("a", None), ("b", "CA")]
    assert {r.provider: r.supported for r in payloads.by_provider(rows).collect()} == {"lever": True, "other": False}


def test_dense_search_in_query_blocks(spark):
    rows = [(i, [float((i * j) % 7 - 3) for j in range(1, 5)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    search = lambda n: sorted(map(tuple, retrieval.dense_top_k(frame, frame, "vec_id", "embedding", "vec_id", "embedding", 5, query_rows=n).select("query", "item", "score", "rank").collect()))
    assert len(search(100)) == 300
    assert search(7) == search(100)


def test_searches_without_sql_take_every_item(spark, tmp_path):
    from quern.plans import retrieving

    source = "/root/testdata/sf0.001"
    (tmp_path / "documents.parquet").symlink_to(f"{source}/documents.parquet")
    items = spark.read.parquet(f"{source}/benchmark.parquet").withColumn("item_id", F.col("item_id") + 30)
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    every = {r.item_id for r in items.collect()}
    for search in (retrieving.rerank_overlap, retrieving.hydrate_parents):
        assert {r.query for r in search(spark, str(tmp_path)).select("query").distinct().collect()} == every


@pytest.mark.parametrize("pairs", [[("a", "x")] * 9 + [("b", "y")] * 5, [("a", "x")] * 9 + [("a", "y")] * 3 + [("b", "y")] * 5, [("a", "x")] * 7 + [("b", "y")] * 5 + [("c", "x")] * 2 + [(None, "z")] * 4, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")] * 3 + [("a", "x")] * 4])
def test_chi_square_counts_empty_cells(spark, pairs):
    from quern.operators import stats

    n, rows, cols = len(pairs), sorted({str(a) for a, _ in pairs}), sorted({str(b) for _, b in pairs})
    dof, total = (len(rows) - 1) * (len(cols) - 1), 0.0
    for a in rows:
        for b in cols:
            e = sum(str(x) == a for x, _ in pairs) * sum(str(y) == b for _, y in pairs) / n
            gap = abs(sum((str(x), str(y)) == (a, b) for x, y in pairs) - e)
            total += (gap - (min(0.5, gap) if dof == 1 else 0)) ** 2 / e
    got = stats.chi_square(spark.createDataFrame(pairs, "a string, b string"), F.col("a"), F.col("b")).first()
    assert (got.dof, got.statistic) == (dof, pytest.approx(total, abs=1e-4))


def test_shards_are_of_one_size(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(103)], "id int, v string").repartition(5)
    files.write_jsonl_shards(frame, f"file://{tmp_path}/shards", 25, "id")
    for i in range(5):
        lines = [json.loads(x) for p in sorted((tmp_path / "shards" / f"shard={i:05d}").glob("*.json")) for x in p.read_text().splitlines()]
        assert [x["id"] for x in lines] == list(range(25 * i, min(103, 25 * i + 25)))
    with pytest.raises(ValueError):
        files.report_json(frame, 100)
