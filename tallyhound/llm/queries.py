"""The thirteen operators' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm import (
    best_fit, exact_dedup, exponion, language_id, piece_transducer, probminhash, qalsh, quality_ftrl, substring_dedup, suffix_dedup, tiered_search, token_files, warc_revisit,
)
from tallyhound.llm.staging import table

PACK_TOKENIZER = "word_bpe_49k.json"
FILE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
SEQUENCE = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def page_captures(pages: DataFrame) -> DataFrame:
    """``pages`` as a crawl of three visits to each address, the later ones mostly not-modified revisits; the
    validators follow from the address. Of revisits only headers are there. A capture's id is 3 * page_id + visit."""
    i, v = F.col("page_id"), F.col("visit")
    once = pages.select("page_id", "url", F.sha2("html", 256).alias("sha"), F.octet_length("html").cast("string").alias("size"), F.substring(F.md5(warc_revisit.canonical_url(F.col("url"))), 1, 12).alias("tag"))
    visits = once.withColumn("visit", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    revisit = F.coalesce((v == 0) & (i % 11 == 0) | (v == 1) | (v == 2) & (i % 2 == 0), F.lit(False))
    etag = F.when((i + v) % 5 != 0, F.concat(F.when(i % 3 == 0, "W/").otherwise(""), F.when((i % 7 == 0) & (v == 1), "x").otherwise(""), F.col("tag")))
    modified = F.when((i + v) % 3 != 1, F.concat(F.lit("2024-01-0"), F.when((i % 13 == 0) & (v == 1), "2").otherwise("1")))
    text = i.cast("string")
    headers = F.when(
        revisit, F.create_map(F.lit("etag"), etag, F.lit("cache-control"), F.concat(F.lit("max-age="), text), F.lit("set-cookie"), F.concat(F.lit("s="), text))
    ).otherwise(F.create_map(F.lit("etag"), etag, F.lit("cache-control"), F.lit("no-cache"), F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.col("size")))
    return visits.select(
        (i * 3 + v).alias("id"), "url", F.timestamp_seconds(i + v * 100_000_000 + 1_000_000_000).alias("ts"), revisit.alias("is_revisit"), etag.alias("etag"), modified.alias("modified"),
        F.when(~revisit, F.col("sha")).alias("digest"), F.map_filter(headers, lambda _, x: x.isNotNull()).alias("headers"),
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisit.resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_keys("merged_headers")), lambda k: F.concat(k, F.lit(": "), F.element_at("merged_headers", k)))
    return found.select(F.col("id").alias("capture_id"), "canonical_url", "status", F.col("resolved_id").alias("resolved_capture_id"), F.col("resolved_digest").alias("body_sha256"), F.array_join(lines, "\n").alias("headers"))


OP2_SQL = r"""
WITH bare AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS b FROM pages),
parts AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), ':(80|443)$', ''), '^www[0-9]*\.', '') AS host,
    regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda x: NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid|ref|sessionid)=|^$'))) AS params
  FROM bare),
c AS (SELECT page_id, html, host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM parts),
t AS (SELECT page_id, canonical_url, html, substr(md5(canonical_url), 1, 12) AS t, unnest([0, 1, 2]) AS n FROM c),
v AS (
  SELECT page_id, page_id * 3 + n AS capture_id, page_id + n * 100000000 AS ts, canonical_url,
    (n = 0 AND page_id % 11 = 0) OR n = 1 OR (n = 2 AND page_id % 2 = 0) AS revisit,
    CASE WHEN (page_id + n) % 5 <> 0 THEN CASE WHEN page_id % 7 = 0 AND n = 1 THEN 'x' ELSE '' END || t END AS tag,
    CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END AS weak,
    CASE WHEN (page_id + n) % 3 <> 1 THEN '2024-01-0' || CASE WHEN page_id % 13 = 0 AND n = 1 THEN '2' ELSE '1' END END AS modified,
    sha256(html) AS digest, strlen(html) AS size
  FROM t),
r AS (
  SELECT *, max(CASE WHEN NOT revisit THEN struct_pack(ts := ts, id := capture_id) END) OVER (PARTITION BY canonical_url ORDER BY ts, capture_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).id AS earlier FROM v),
m AS (
  SELECT a.*, b.tag AS b_tag, b.weak AS b_weak, b.modified AS b_modified, b.digest AS b_digest, b.size AS b_size,
    coalesce(a.tag = b.tag, a.modified = b.modified) AS agree FROM r a LEFT JOIN v b ON a.earlier = b.capture_id),
s AS (SELECT *, CASE WHEN NOT revisit THEN 'response' WHEN earlier IS NULL THEN 'orphan' WHEN agree IS NULL THEN 'unchecked' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status FROM m)
SELECT capture_id, canonical_url, status,
  CASE WHEN status = 'response' THEN capture_id WHEN status IN ('resolved', 'unchecked') THEN earlier END AS resolved_capture_id,
  CASE WHEN status = 'response' THEN digest WHEN status IN ('resolved', 'unchecked') THEN b_digest END AS body_sha256,
  CASE WHEN status = 'response' THEN concat_ws(chr(10), 'cache-control: no-cache', 'content-length: ' || size, 'content-type: text/html', 'etag: ' || weak || tag)
    WHEN status IN ('resolved', 'unchecked') THEN concat_ws(chr(10), 'cache-control: max-age=' || page_id, 'content-length: ' || b_size, 'content-type: text/html',
      coalesce('etag: ' || weak || tag, 'etag: ' || b_weak || b_tag)) END AS headers
FROM s
"""


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER), SEQUENCE)


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_classes(table(spark, sf_dir, "documents")).drop("key")


def op5_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_ftrl.score(docs, quality_ftrl.fit(docs, table(spark, sf_dir, "labels")))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, *language_id.fit(docs))


def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), 200)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), 20).drop("n_spans")


def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qalsh.nearest(table(spark, sf_dir, "embeddings"))


def op11_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiered_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
d AS (SELECT r, doc_id, words, len(words) AS n FROM t WHERE len(words) > 0),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT n_docs FROM s) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p GROUP BY term),
i AS (
  SELECT item_id, row_number() OVER () AS q,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
q AS (SELECT DISTINCT q, item_id, unnest(words) AS term FROM i),
m AS (SELECT r, doc_id, 100 - 50 + (50 * n * n_docs) // l AS m FROM d, s),
scores AS (
  SELECT q.q, q.item_id, m.doc_id, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN w ON q.term = w.term JOIN p ON p.term = q.term JOIN m ON m.r = p.r
  GROUP BY q.q, q.item_id, m.doc_id, p.r),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
"""


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(FILE_TOKENIZER))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exponion.vector_codes(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = 2, parts: int = 16, entries: int = 64) -> str:
    """One common table for each step: entries, nearest entries, new entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
near{k} AS (
  SELECT r, p, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT x.r, x.p, b.e, list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
        FROM cut x JOIN book{k} b ON x.p = b.p)
  GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT p, e, list(CAST(floor(total / many) AS BIGINT) ORDER BY j) AS x
  FROM (SELECT c.p, n.best.e AS e, j, CAST(sum(c.x[j]) AS DOUBLE) AS total, count(*) AS many
        FROM near{k} n JOIN cut c ON c.r = n.r AND c.p = n.p, unnest(range(1, len(c.x) + 1)) AS u(j)
        GROUP BY c.p, n.best.e, j)
  GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM kept, range({parts}) AS u(p)),
book0 AS (SELECT p, r AS e, x FROM cut WHERE r < {entries}),{",".join(steps)},
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM book{rounds}),
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept k JOIN coded c ON c.r = k.r, sha
"""


OPERATORS = (
    op1_exact_dedup, op2_warc_revisits, op3_best_two_fit, op4_probminhash, op5_quality_ftrl, op6_piece_transducer, op7_suffix_dedup, op8_language_mixture, op9_substring_dedup,
    op10_collision_counting, op11_tiered_search, op12_token_files, op13_exponion_codes,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_warc_revisits": OP2_SQL, "op11_tiered_search": OP11_SQL, "op13_exponion_codes": _codes_sql()}
