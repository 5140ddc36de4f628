"""The registered queries of this subpackage, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bind import let
from . import binary_output, divergence, hamming, licenses, line_dedup, mixing, nearest, packing, periods, set_join, token_counts, toxicity, warc
from .common import table


def op1_hamming_topk(spark, sf_dir):
    return hamming.hamming_nearest(table(spark, sf_dir, "embeddings"), k=10)


def op2_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), k=5)


def op3_wavelet_output(spark, sf_dir):
    return binary_output.binary_output(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix_taken(table(spark, sf_dir, "documents"))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.warc_roundtrip(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark, sf_dir):
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_licences(spark, sf_dir):
    return licenses.scan_licences(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark, sf_dir):
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def with_planted_periods(docs):
    """Of every document with ``crc32(doc_id) % 10 = 0``, the words behind a prefix repeat with a period (both from the crc32). Null ids stay as they are."""
    h, blank = F.crc32(F.col("doc_id").cast("string").cast("binary")), "[\\x20\\x09-\\x0D]+"
    g = F.floor(h / 10).cast("long")

    def turned(words):
        n = F.size(words).cast("long")
        spans = F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("long").alias("p"))
        return let(spans, lambda s: F.array_join(F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, (s["a"] + (i - s["a"]) % s["p"]).cast("int")))), " "))

    bare = F.regexp_replace("text", f"^{blank}|{blank}$", "")
    return docs.select("doc_id", F.when((h % 10 == 0) & (bare != ""), let(F.split(bare, blank), turned)).otherwise(F.col("text")).alias("text"))


def op13_periods(spark, sf_dir):
    found = periods.periodic_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select("doc_id", "runs", "text", best.alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (op1_hamming_topk, op2_nearest, op3_wavelet_output, op4_mixing, op5_token_counts, op6_packing, op7_warc, op8_jaccard_join, op9_licences, op10_toxicity, op11_divergence, op12_line_dedup, op13_periods)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op1_hamming_topk": """
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(list_zip(q.embedding, c.embedding), lambda z: (z[1] > 0) <> (z[2] > 0))) AS BIGINT) AS distance
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.embedding) = len(c.embedding)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, distance FROM ranked WHERE r <= 10
""",
    "op2_nearest": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op7_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
last AS (SELECT digest, max(page_id) AS page_id FROM p WHERE n >= 1000 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN last.page_id > coalesce(p.page_id, last.page_id - 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last.page_id > coalesce(p.page_id, last.page_id - 1) THEN last.page_id END AS refers_to
FROM p LEFT JOIN last ON p.digest = last.digest
""",
    "op8_jaccard_join": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.d),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.d = d.doc_id
""",
    "op11_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY 1, 2, 3),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY 1, 2),
p AS (
  SELECT t.lang, t.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM t JOIN kept ON kept.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200
""",
    "op12_line_dedup": f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM s),
k AS (SELECT doc_id, line, pos, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
o AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, o.first IS NOT NULL AND k.doc_id > o.first AS gone FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
