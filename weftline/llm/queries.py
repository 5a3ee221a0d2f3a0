"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.llm import ctw, decontaminate, htmltext, langid, linededup, mergedropout, neardup, runs, secrets, substrdedup, topk, warc, whitening
from weftline.llm._spark import table

#: The public vocabulary that the queries encode with; a parameter of the operator.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_ctw_score(spark, sf_dir):
    return ctw.report(table(spark, sf_dir, "documents"))


def op2_html_extract(spark, sf_dir):
    return htmltext.extract_pages(table(spark, sf_dir, "pages"))


def op3_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return topk.top_k(e.where(F.col("vec_id") % 20 == 0), e)


def op4_line_dedup(spark, sf_dir):
    return linededup.report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark, sf_dir):
    return substrdedup.report(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark, sf_dir):
    return mergedropout.encode(table(spark, sf_dir, "documents"), MODEL_FILE)


def op8_language_id(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


def op9_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_minhash(spark, sf_dir):
    return neardup.report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return runs.report(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.report(table(spark, sf_dir, "embeddings"))


def op13_warc(spark, sf_dir):
    return warc.report(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_ctw_score, op2_html_extract, op3_topk, op4_line_dedup, op5_decontaminate, op6_substring_dedup, op7_sentencepiece, op8_language_id, op9_secrets, op10_minhash, op11_periodic_runs, op12_whitening, op13_warc)}

_KEY = "regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

_SPLIT = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

ORACLE = {
    "op6_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
     x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
           FROM w WHERE len(w) >= 50),
     m AS (SELECT h, min(doc_id) AS lo FROM x GROUP BY h),
     g AS (SELECT DISTINCT doc_id, p + unnest(range(50)) AS pos FROM x JOIN m USING (h) WHERE doc_id > lo),
     a AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
     k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.pos) AS kept, count(*) AS n FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos WHERE g.pos IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id""",
    "op10_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN list_transform(list_slice(w, 1, 1), lambda x: x)
                  ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
     x AS (SELECT doc_id, unnest(s) AS g FROM s),
     n AS (SELECT doc_id, len(s) AS n FROM s),
     i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
     u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
     r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.c = u.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY n.doc_id, n.n""",
    "op3_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id,
                  CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20""",
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
     k AS (SELECT *, translate({_KEY}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     h AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     f AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id < h.owner AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id""",
    "op13_warc": """
WITH p AS (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS b, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE b >= 100 GROUP BY d)
SELECT page_id, b AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NOT NULL AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS verified, url AS uri
FROM p LEFT JOIN f ON p.d = f.d""",
}
