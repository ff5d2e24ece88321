"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bwt_dedup, decontaminate, html_region, near_dedup, ngram_lm, pieces, quality, secrets, toxicity, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_region.extract_pages(_table(spark, sf_dir, "pages"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), decoded_col="decoded")
    return out.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.find_secrets(_table(spark, sf_dir, "documents"), forest)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html": op1_html,
    "op2_pieces": op2_pieces,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_vectors": op5_vectors,
    "op6_ngram_lm": op6_ngram_lm,
    "op7_quality": op7_quality,
    "op8_bwt_dedup": op8_bwt_dedup,
    "op9_secrets": op9_secrets,
    "op10_decontaminate": op10_decontaminate,
}

# op1: what the article element of these pages holds, which the operator must find without being told that element; op5: all
# pairs, which the search equals where it probes all lists, as on small tables.
ORACLE_SQL: dict[str, str] = {
    "op1_html": r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(body, '</?p>|<br>|</?h1>') AS blocks FROM a),
t AS (SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '</?b>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM b)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), ' ') AS text, CAST(length(array_to_string(list_filter(parts, lambda x: x <> ''), ' ')) AS BIGINT) AS n_chars FROM t
""",
    "op5_vectors": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op8_bwt_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i + 1:i + 400]) AS h FROM (SELECT r, b, unnest(range(octet_length(b) - 399)) AS i FROM d WHERE octet_length(b) >= 400)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM m)),
s AS (SELECT r, run, min(i) AS a, max(i) + 400 AS e FROM g GROUP BY 1, 2),
p AS (SELECT s.r, a, d.b[coalesce(lag(e) OVER (PARTITION BY s.r ORDER BY a), 0) + 1:a] AS piece FROM s JOIN d ON d.r = s.r
  UNION ALL SELECT d.r, octet_length(any_value(d.b)) + 1, any_value(d.b)[coalesce(max(e), 0) + 1:octet_length(any_value(d.b))] FROM d LEFT JOIN s ON s.r = d.r GROUP BY d.r),
k AS (SELECT r, unhex(string_agg(hex(piece), '' ORDER BY a)) AS rest FROM p GROUP BY r),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r)
SELECT d.doc_id, CAST(octet_length(d.b) AS BIGINT) AS n_bytes, CAST(octet_length(d.b) - octet_length(k.rest) AS BIGINT) AS n_removed, CAST(coalesce(n.n, 0) AS BIGINT) AS n_spans, sha256(k.rest) AS kept_sha256
FROM d JOIN k ON k.r = d.r LEFT JOIN n ON n.r = d.r
""",
    "op10_decontaminate": r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS a FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS a FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT r, len(a) AS words, greatest(len(a) - 4, 1) AS n, unnest(range(greatest(len(a) - 4, 1))) AS pos, unnest([array_to_string(a[k + 1:k + 5], ' ') FOR k IN range(greatest(len(a) - 4, 1))]) AS sh FROM dw WHERE len(a) > 0),
es AS (SELECT q, greatest(len(a) - 4, 1) AS m, unnest([array_to_string(a[k + 1:k + 5], ' ') FOR k IN range(greatest(len(a) - 4, 1))]) AS sh FROM iw WHERE len(a) > 0),
e AS (SELECT q, m, sh, count(*) AS ec FROM es GROUP BY 1, 2, 3),
hit AS (SELECT ds.r, e.q, ds.pos, ds.sh, e.ec, e.m, ds.n, ds.words FROM ds JOIN e ON e.sh = ds.sh),
win AS (SELECT DISTINCT r, q, m, n, words, unnest(range(greatest(least(pos - m + 1, greatest(n - m, 0)), 0), least(pos, greatest(n - m, 0)) + 1)) AS s FROM hit),
sim AS (SELECT r, q, s, m, n, words, sum(x) AS b FROM (
  SELECT win.r, win.q, win.s, win.m, win.n, win.words, least(count(*), any_value(hit.ec)) AS x FROM win JOIN hit ON hit.r = win.r AND hit.q = win.q AND hit.pos >= win.s AND hit.pos < win.s + win.m GROUP BY 1, 2, 3, 4, 5, 6, hit.sh) GROUP BY 1, 2, 3, 4, 5, 6),
j AS (SELECT *, CAST(b AS DOUBLE) / CAST(least(m, n - s) + m - b AS DOUBLE) AS similarity FROM sim),
best AS (SELECT *, row_number() OVER (PARTITION BY r, q ORDER BY similarity DESC, s) AS k FROM j WHERE similarity >= 0.8)
SELECT dw.doc_id, iw.item_id, similarity, CAST(s AS BIGINT) AS start_word, CAST(least(least(m, n - s) + 4, words) AS BIGINT) AS n_words FROM best JOIN dw ON dw.r = best.r JOIN iw ON iw.q = best.q WHERE k = 1
""",
    "op4_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')]
      ELSE [array_to_string(a[i:i + 3], ' ') FOR i IN range(1, len(a) - 2)] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) c USING (doc_id)
""",
}
