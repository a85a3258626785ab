"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import impact_index, line_dedup, quality_rules, substring_dedup, vector_codes

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY_RULES = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
          FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM tokens)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
    SELECT t.doc_id, t.source, CAST(len(t.w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM tokens t LEFT JOIN covered c USING (r) LEFT JOIN lines l USING (r)),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality_rules.MAX_REPEAT_PERCENT} AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS failures FROM judged GROUP BY source),
moments AS (SELECT CAST(sum(failures) AS DOUBLE) / sum(n) AS mean, var_samp(failures / n) AS v, avg(1.0 / n) AS noise FROM hosts),
prior AS (SELECT mean, coalesce(CASE WHEN v - mean * (1 - mean) * noise > 0
    THEN greatest(1.0, mean * (1 - mean) / (v - mean * (1 - mean) * noise) - 1) END, {quality_rules.PRIOR_WEIGHT}) AS weight FROM moments),
rates AS (SELECT source, (failures + mean * weight) / (n + weight) AS rate FROM hosts, prior)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rate <= {quality_rules.MAX_RATE} AS kept
FROM judged j JOIN rates h ON j.source IS NOT DISTINCT FROM h.source
"""

LINE_DEDUP = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM texts),
keyed AS (SELECT *, {_FOLD.format(f"trim(line, {_SPACES})")} AS key FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= {line_dedup.MIN_CHARS} AND doc_id IS NOT NULL
           GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, coalesce(k.doc_id > o.owner, false) AS gone FROM keyed k LEFT JOIN owners o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

SUBSTRING_DEDUP = rf"""
WITH tokens AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, p, array_to_string(w[p:p + {substring_dedup.WINDOW - 1}], ' ') AS g
            FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - {substring_dedup.WINDOW - 2}, 1))) AS p FROM tokens)),
firsts AS (SELECT g, min({{'d': doc_id, 'p': p}}) AS f FROM windows WHERE doc_id IS NOT NULL GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {substring_dedup.WINDOW})) AS q FROM windows JOIN firsts USING (g)
         WHERE doc_id > f.d OR (doc_id = f.d AND p > f.p)),
placed AS (SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM tokens),
kept AS (SELECT p.r, count(g.q) AS n_removed, string_agg(word, ' ' ORDER BY p.q) FILTER (g.q IS NULL) AS text
         FROM placed p LEFT JOIN gone g ON p.r = g.r AND p.q = g.q GROUP BY p.r)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM tokens t LEFT JOIN kept k USING (r)
"""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
taking AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0
           AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS id FROM taking a JOIN taking b ON a.r <> b.r AND len(a.x) = len(b.x)
          WHERE CASE WHEN len(a.x) = len(b.x) THEN list_cosine_similarity(a.x, b.x) >= 0.95 END),
reach AS (SELECT r AS a, r AS b, vec_id AS id FROM taking UNION SELECT reach.a, links.b, links.id FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(id) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(counts.n, 0) AS n_links, coalesce(least.component_id, v.vec_id) AS component_id,
    v.vec_id IS NOT DISTINCT FROM coalesce(least.component_id, v.vec_id) AS kept
FROM v LEFT JOIN least ON v.r = least.a LEFT JOIN counts ON v.r = counts.a
"""


def _vector_codes() -> str:
    """Every round spelled out: assign parts to entries, replace entries by floored means."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // {vector_codes.PARTS} + 1 : (p + 1) * len(v) // {vector_codes.PARTS}] AS q
    FROM kept, (SELECT unnest(range({vector_codes.PARTS})) AS p))""",
        f"books0 AS MATERIALIZED (SELECT p, r - 1 AS e, q AS c FROM parts WHERE r <= {vector_codes.ENTRIES})",
    ]
    assign = """near{i} AS MATERIALIZED (SELECT r, p, min({{'d': CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': e}}) AS m
    FROM parts JOIN books{i} USING (p) GROUP BY r, p)"""
    for i in range(vector_codes.ROUNDS):
        steps += [
            assign.format(i=i),
            f"""sums{i} AS MATERIALIZED (SELECT p, e, pos, sum(x) AS s, count(*) AS n FROM (
    SELECT p, m.e AS e, unnest(q) AS x, unnest(range(len(q))) AS pos FROM parts JOIN near{i} USING (r, p)) GROUP BY p, e, pos)""",
            f"""books{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM books{i} b LEFT JOIN (
    SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS c FROM sums{i} GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""",
        ]
    last = vector_codes.ROUNDS
    steps += [
        assign.format(i=last),
        f"coded AS (SELECT r, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{last} GROUP BY r)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books{last})",
    ]
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""


IMPACT_INDEX = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("text")}, '{impact_index.TERM}') AS w FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(w) AS n, w FROM docs WHERE len(w) > 0),
corpus AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM sized),
items AS (SELECT DISTINCT item_id, text, regexp_extract_all({_FOLD.format("text")}, '{impact_index.TERM}') AS w FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(w) AS term FROM items) GROUP BY ALL),
counted AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus),
lengths AS (SELECT r, doc_id, 100 - {impact_index.LENGTH_PERCENT} + ({impact_index.LENGTH_PERCENT} * n * big_n) // l AS m FROM sized, corpus),
scored AS (SELECT item_id, text, r, CAST(sum(times * w * (({impact_index.ONE} * tf) // (1000 * tf + {impact_index.SATURATION} * m))) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (r) GROUP BY ALL),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
           FROM scored JOIN lengths USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": QUALITY_RULES,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op9_line_dedup": LINE_DEDUP,
    "op11_neighbour_graph": NEAR_VECTORS,
    "op12_vector_codes": _vector_codes(),
    "op13_impact_index": IMPACT_INDEX,
}
