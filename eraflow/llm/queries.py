"""Registered queries of the text operators, with reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment, archives, disclosure, dualtree, embeddings, extract, licenses, minhash, mixing, suffixes, tiling, tokens, toxicity,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grammar = toxicity.fit(docs, labels.where(~toxicity.is_held_out()))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", "predicted", "n_patterns")


#: components of a table ``link`` (a, b) with both directions and every node's loop
_REACH = """
reach(id, root) AS (
  SELECT DISTINCT a, b FROM link
  UNION
  SELECT r.id, l.b FROM reach r JOIN link l ON r.root = l.a
)"""

OP2_SQL = f"""
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.vec_id = y.vec_id OR list_cosine_similarity(x.v, y.v) >= 0.95
), {_REACH}
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(m.root, e.vec_id) AS component_id, coalesce(m.root, e.vec_id) = e.vec_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) - 1 AS n FROM link GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = e.vec_id
"""


@query("op2_embedding_near_dedup", OP2_SQL)
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


OP3_SQL = """
WITH raw AS (
  SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents
), byte AS (
  SELECT doc_id, h, unnest(generate_series(0, octet_length(h) - 200)) AS p FROM raw WHERE octet_length(h) >= 200
), win AS (SELECT doc_id, p, md5(h[p + 1 : p + 200]) AS w FROM byte
), twice AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1
), hit AS (
  SELECT doc_id, p AS b, p + 200 AS e FROM win SEMI JOIN twice USING (w)
), marked AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hit
), island AS (
  SELECT *, sum((reach IS NULL OR b > reach)::INT) OVER (PARTITION BY doc_id ORDER BY b) AS i FROM marked
), span AS (SELECT doc_id, min(b) AS b, max(e) AS e FROM island GROUP BY doc_id, i
), edged AS (
  SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before, lead(b) OVER (PARTITION BY doc_id ORDER BY b) AS after FROM span
), cut AS (
  SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans,
    string_agg(hex(h[before + 1 : b]) || CASE WHEN after IS NULL THEN hex(h[e + 1 :]) ELSE '' END, '' ORDER BY b) AS kept
  FROM edged JOIN raw USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, octet_length(h)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(coalesce(unhex(kept), h)) AS kept_sha256
FROM raw LEFT JOIN cut USING (doc_id)
"""


@query("op3_suffix_dedup", OP3_SQL)
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(table(spark, sf_dir, "documents"), length=200)
    return cut.select(
        "doc_id", (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed",
        F.coalesce(F.size("spans"), F.lit(0)).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


OP4_SQL = f"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, list_aggregate(w[k : k + 3], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS k FROM word WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id, coalesce(m.root, d.doc_id) = d.doc_id AS kept
FROM documents d
LEFT JOIN size n ON n.doc_id = d.doc_id
LEFT JOIN (SELECT id, min(root) AS root FROM reach GROUP BY id) m ON m.id = d.doc_id
"""


@query("op4_minhash_near_dedup", OP4_SQL)
def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


OP5_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source
), weighed AS (SELECT source, n, sqrt(n) AS w FROM counts
), sums AS (SELECT sum(n) AS all_n, sum(w::DECIMAL(30,12))::DOUBLE AS all_w FROM weighed
), rate AS (SELECT source, (all_n * w) / (all_w * n) AS r FROM weighed, sums
), cdf(source, r, k, term, total) AS (
  SELECT source, r, 0, exp(-r), exp(-r) FROM rate
  UNION ALL
  SELECT source, r, k + 1, term * r / (k + 1), total + term * r / (k + 1) FROM cdf WHERE k < r + 12 * sqrt(r) + 40
), keyed AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS key FROM documents
), drawn AS (
  SELECT d.doc_id, d.source, d.key, count(c.k) AS n_copies
  FROM (SELECT *, ('0x' || substr(md5('17|1|' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM keyed) d
  JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.total <= d.u
  GROUP BY ALL
), copies AS (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM drawn)
SELECT doc_id, source, copy, n_copies, ('0x' || substr(md5('order 17|' || copy || '|' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key
FROM copies
"""


@query("op5_source_mixing", OP5_SQL)
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root smoothed source weights, as many rows as the input in the mean."""
    mixed = mixing.mixture(table(spark, sf_dir, "documents"), power=0.5)
    return mixed.select("doc_id", "source", "copy", "n_copies", "shuffle_key")


OP6_SQL = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages
), marked AS (SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, sha1(p) AS h FROM page WHERE page_id IS NOT NULL
), first AS (SELECT h, max(page_id) AS first FROM marked GROUP BY h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM marked JOIN first USING (h)
"""


@query("op6_warc_packages", OP6_SQL)
def op6_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = archives.write_packages(table(spark, sf_dir, "pages"), least_bytes=0)
    return archives.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_texts(table(spark, sf_dir, "pages"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_notices(table(spark, sf_dir, "documents"), containment=0.8)
    return found.withColumn("n_licenses", F.size("licenses"))


@query("op10_benchmark_decontamination")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = tiling.contaminated(docs, table(spark, sf_dir, "benchmark"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    hit = hit.withColumnRenamed("text_key", "hit_key")
    out = keyed.join(hit, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("hit_key")), "left")
    return out.select(
        "doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


@query("op11_private_terms")
def op11_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.private_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"),
        F.concat_ws(",", F.expr("nullif(base_spans, '')"), F.expr("nullif(term_spans, '')")).alias("spans"), "n_terms",
    )


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


OP13_SQL = """
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), item AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM item
), size AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM doc GROUP BY r
), total AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM size
), held AS (SELECT r, term, count(*) AS tf FROM doc SEMI JOIN asked USING (term) GROUP BY r, term
), rare AS (SELECT term, count(*) AS df FROM held GROUP BY term
), part AS (
  SELECT r, term, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))) AS x
  FROM held JOIN rare USING (term) JOIN size USING (r), total
), scored AS (
  SELECT i, any_value(item_id) AS item_id, r, sum(x)::BIGINT AS score FROM asked JOIN part USING (term) GROUP BY i, r HAVING sum(x) > 0
), placed AS (
  SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank FROM scored JOIN (SELECT r, doc_id FROM size) USING (r)
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""


@query("op13_dual_tree_search", OP13_SQL)
def op13_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
