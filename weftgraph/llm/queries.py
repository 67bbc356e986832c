"""The registered queries of this folder, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import op1_ngram_join, op2_licenses, op3_urls, op4_mixing, op5_language, op6_neighbours, op7_decontaminate, op8_toxicity, op9_lines, op10_secrets
from .common import table


def op1_ngram_join_query(spark, d):
    return op1_ngram_join.ngram_components(table(spark, d, "documents"))


def op2_license_scan(spark, d):
    got = op2_licenses.scan_licenses(table(spark, d, "documents"))
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_url_filter(spark, d):
    return op3_urls.judge_urls(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing_query(spark, d):
    return op4_mixing.mix(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_language_id(spark, d):
    docs = table(spark, d, "documents")
    model = op5_language.fit(docs.where(~op5_language.held_out(F.col("doc_id"))))
    return op5_language.predict(docs, model)


def op6_neighbours_query(spark, d):
    return op6_neighbours.nearest(table(spark, d, "embeddings"))


def op7_decontamination(spark, d):
    got = op7_decontaminate.find_benchmark(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_toxicity_query(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return op8_toxicity.score(docs, op8_toxicity.fit(docs, labels.where(~op8_toxicity.held_out(F.col("doc_id")))))


def op9_line_dedup(spark, d):
    docs = table(spark, d, "documents")
    return op9_lines.line_report(docs, op9_lines.site_of(docs))


def op10_secret_scan(spark, d):
    return op10_secrets.scan_secrets(table(spark, d, "documents"))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


QUERIES = {
    "op1_ngram_join": op1_ngram_join_query,
    "op2_license_scan": op2_license_scan,
    "op3_url_filter": op3_url_filter,
    "op4_mixing": op4_mixing_query,
    "op5_language_id": op5_language_id,
    "op6_neighbours": op6_neighbours_query,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity_query,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scan": op10_secret_scan,
    "pipeline": pipeline,
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = _LOW.format("coalesce(text, '')")
_WORDS = rf"regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2""",
    "op3_url_filter": rf"""
WITH RECURSIVE links AS (
  SELECT url AS a, unnest([regexp_extract(html, '(?is)<link\b[^>]*\brel=["'']?canonical\b[^>]*\bhref=["'']?([^"''>\s]+)', 1),
    regexp_extract(html, '(?is)<link\b[^>]*\bhref=["'']?([^"''>\s]+)[^>]*\brel=["'']?canonical\b', 1),
    regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv=["'']?refresh\b[^>]*\burl=["'']?([^"''>\s]+)', 1)]) AS t
  FROM pages WHERE regexp_matches(html, '(?i)canonical|refresh')),
whole AS (SELECT a, CASE WHEN t LIKE '//%' THEN regexp_extract(a, '^([^:/?#]*):', 1) || ':' || t
    WHEN t LIKE '/%' THEN regexp_extract(a, '^([^:/?#]*):', 1) || '://' || {_LOW.format("regexp_extract(a, '://([^/?#]*)', 1)")} || t WHEN contains(t, '://') THEN t END AS b FROM links WHERE t <> ''),
urls AS (SELECT url AS u FROM pages WHERE url IS NOT NULL UNION SELECT a FROM whole WHERE b IS NOT NULL UNION SELECT b FROM whole WHERE b IS NOT NULL),
parts AS (SELECT u, {_LOW.format("regexp_extract(u, '://([^/?#]*)', 1)")} AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '://[^?#]*(\?[^#]*)', 1) AS q FROM urls),
ruled AS (SELECT u, host, path, host || CASE WHEN path = '' THEN '/' ELSE path END || q AS node, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM ruled),
edge AS (SELECT x.node AS a, y.node AS b FROM whole JOIN judged x ON x.u = whole.a JOIN judged y ON y.u = whole.b WHERE x.host <> '' AND y.host <> ''),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
passed AS (SELECT reach.a AS node, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' END AS v FROM reach JOIN judged ON judged.node = reach.b GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(own, v, 'allow') AS verdict
FROM pages LEFT JOIN judged ON judged.u = pages.url LEFT JOIN passed ON passed.node = judged.node""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest([array_to_string(w[j:j + least(len(w), 10) - 1], ' ') for j in range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS s, unnest([array_to_string(w[j:j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) AS g FROM d, ks WHERE len(w) >= k),
h AS (SELECT dw.doc_id, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS x FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS x FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(x, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_line_dedup": f"""
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l FROM documents),
u AS (SELECT DISTINCT source, text, l FROM p WHERE text IS NOT NULL),
n AS (SELECT source, count(*) AS total FROM u GROUP BY 1),
e AS (SELECT source, x, count(*) AS c FROM (SELECT source, unnest(list_distinct([trim(y, ' ') for y in l if trim(y, ' ') <> ''])) AS x FROM u) GROUP BY 1, 2),
b AS (SELECT e.source, list(x) AS drops FROM e JOIN n ON e.source IS NOT DISTINCT FROM n.source WHERE c >= {op9_lines.MIN_PAGES} AND c > CAST({op9_lines.RATIO} AS DOUBLE) * total GROUP BY 1),
k AS (SELECT doc_id, text, l, CASE WHEN drops IS NULL THEN l ELSE [y for y in l if NOT list_contains(drops, trim(y, ' '))] END AS k FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - len(k), 0) AS BIGINT) AS n_dropped, CASE WHEN text IS NOT NULL THEN md5(coalesce(array_to_string(k, chr(10)), '')) END AS kept_md5 FROM k""",
}
