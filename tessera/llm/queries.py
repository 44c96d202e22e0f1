"""Registered queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import backoff, decontam, fingerprints, licenses, mixing, neardup, pii, quality, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op2_stupid_backoff(spark, sf_dir):
    out = backoff.stupid_backoff(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 4) for c in ("score", "mean_score")})


def op3_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), num=85).drop("set_id", "cluster")


def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op6_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("source")


def op8_warc(spark, sf_dir):
    uri = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, uri, with_payload=False).drop("payload", "url")


def op9_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op10_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents")).drop("found")


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_stupid_backoff, op3_near_duplicates, op4_quality, op5_secrets, op6_decontamination, op7_mixing, op8_warc, op9_licenses, op10_pii, pipeline)}

FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = {
    "op2_stupid_backoff": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS q FROM t),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w),
c2 AS (SELECT p, w, count(*) AS n FROM g WHERE p IS NOT NULL GROUP BY p, w),
c3 AS (SELECT q, p, w, count(*) AS n FROM g WHERE q IS NOT NULL GROUP BY q, p, w),
two AS (SELECT g.*, c2.n AS n2, ln(c1.n / (SELECT count(*) FROM t)) AS s1, ln(c2.n / cp.n) AS s2
        FROM g JOIN c1 ON c1.w = g.w LEFT JOIN c2 ON c2.p = g.p AND c2.w = g.w LEFT JOIN c1 cp ON cp.w = g.p),
three AS (SELECT r, CASE WHEN two.p IS NULL THEN s1 WHEN n2 >= 2 THEN s2 ELSE s1 + ln(0.4) END AS shorter, c3.n AS n3, ln(c3.n / cq.n) AS s3
          FROM two LEFT JOIN c3 ON c3.q = two.q AND c3.p = two.p AND c3.w = two.w LEFT JOIN c2 cq ON cq.p = two.q AND cq.w = two.p),
s AS (SELECT r, sum(CASE WHEN n3 IS NULL THEN shorter WHEN n3 >= 2 THEN s3 ELSE shorter + ln(0.4) END) AS score FROM three GROUP BY r)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS score, round(score / len(d.w), 4) AS mean_score FROM d LEFT JOIN s ON s.r = d.r""",
    "op3_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
sets AS (SELECT r, n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s JOIN n USING (r) GROUP BY r, n),
one AS (SELECT h, min(r) AS r, min(n) AS n FROM sets GROUP BY h),
own AS (SELECT s.r, s.g FROM s JOIN one USING (r)),
met AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM own a JOIN own b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM met JOIN one p ON p.r = x JOIN one q ON q.r = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
way AS (SELECT x AS a, y AS b FROM link UNION SELECT y, x FROM link),
reach AS (SELECT r AS a, r AS b FROM one UNION SELECT e.a, w.b FROM reach e JOIN way w ON w.a = e.b),
part AS (SELECT a AS r, min(b) AS part FROM reach GROUP BY a),
placed AS (SELECT d.doc_id, d.r, coalesce(t.n, 0) AS n, p.part FROM d LEFT JOIN sets t ON t.r = d.r LEFT JOIN one o ON o.h = t.h LEFT JOIN part p ON p.r = o.r),
first AS (SELECT part, min(doc_id) AS first FROM placed WHERE part IS NOT NULL GROUP BY part)
SELECT doc_id, n AS n_shingles, coalesce(first, doc_id) AS component_id, coalesce(doc_id = coalesce(first, doc_id), false) AS kept FROM placed LEFT JOIN first USING (part)""",
    "op6_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({FOLDED}, '{ITEM_WORDS}'), []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({FOLDED}, '{ITEM_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i, least(len(w), 10) AS n, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, unnest(range(1, len(w) - n + 2)) AS i, n, w FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT doc_id, i, p.n, item FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM pos) p JOIN win ON win.n = p.n AND win.k = p.k),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS response FROM p GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)::BIGINT, 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN m ON p.h = m.h""",
}
