"""The operators' queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import importance, jaccard_join, language_id, packing, passages, quality_classifier, quality_rules, resharding, sentencepieces, token_planes, topk_search, url_filters, whitening

#: The url rules, as (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), *quality_rules.COUNTS, "base_failed", "kept")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_planes.encode(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: The old layout of the documents: a shard for each bucket of sources, so that a hot source makes a hot shard.
OLD_SHARDS, NEW_SHARDS = 16, 16


def op3_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    out, _ = resharding.reshard(_table(spark, sf_dir, "documents"), old, OLD_SHARDS, NEW_SHARDS)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_exact_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"))


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filters.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(_table(spark, sf_dir, "documents"))


def op9_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded by pieces, decoded from the ids alone; ids_crc32 is over little-endian 32-bit integers."""
    out = sentencepieces.encode(_table(spark, sf_dir, "documents"), decoded=True, digest=True)
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids_crc32",
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.octet_length("decoded").cast("long").alias("decoded_bytes"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_planes": op2_token_planes,
        "op3_min_cost_flow_resharding": op3_min_cost_flow_resharding,
        "op4_jaccard_tiles": op4_jaccard_tiles,
        "op5_exact_topk_nra": op5_exact_topk_nra,
        "op6_bounded_packing": op6_bounded_packing,
        "op7_url_filters": op7_url_filters,
        "op8_compact_windows": op8_compact_windows,
        "op9_sentencepiece_viterbi": op9_sentencepiece_viterbi,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_language_id": op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL,
        "op4_jaccard_tiles": OP4_SQL,
        "op5_exact_topk_nra": OP5_SQL,
        "op7_url_filters": OP7_SQL,
        "op11_importance_resampling": OP11_SQL,
    }


OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
runs AS (
  SELECT r, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM d WHERE len(w) >= 8),
keyed AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM runs),
found AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM found WHERE n > 1) GROUP BY r),
raw_lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (
  SELECT r, source, text, line,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS host_texts FROM d GROUP BY source),
counted AS (SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY source, norm),
frequent AS (
  SELECT c.source, c.norm FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n > {quality_rules.MIN_TEXTS} AND c.n > {quality_rules.SHARE} * h.host_texts),
removed AS (
  SELECT l.r, sum(len(string_split(l.norm, ' '))) AS n
  FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY l.r),
base AS (
  SELECT d.r, d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed.n, 0) AS gone
  FROM d LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - gone < {quality_rules.LEFT} * n_words) AS kept
FROM base
"""

OP7_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rhost, rpath) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT q.page_id, q.host, q.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
         arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM q LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY q.page_id, q.host, q.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, min(r.y)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id, n.n
"""

#: CRC-32 of each distinct feature by its table of 256 entries, which a rule builds.
OP11_SQL = r"""
WITH rule AS (
  SELECT list(c ORDER BY b) AS crc FROM (
    SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) r(b))),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
of_documents AS (
  SELECT r, f, count(*) AS n FROM (
    SELECT r, unnest(w) AS f FROM d UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY ALL),
of_target AS (
  SELECT f, count(*) AS n FROM (
    SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b) GROUP BY ALL),
texts AS (SELECT f, hex(encode(f)) AS h FROM of_documents UNION SELECT f, hex(encode(f)) FROM of_target),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM texts, rule),
s AS (SELECT bucket, sum(n) AS n FROM of_documents JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM of_target JOIN hashed USING (f) GROUP BY bucket),
sizes AS (SELECT coalesce((SELECT sum(n) FROM s), 0) AS s_all, coalesce((SELECT sum(n) FROM t), 0) AS t_all),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), sizes),
weights AS (
  SELECT r, sum(n) AS n, (sum(n * gain) - ((sum(n * gain) % sum(n)) + sum(n)) % sum(n)) // sum(n) AS weight
  FROM of_documents JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS able
  FROM scored WHERE n_words >= 20 AND score IS NOT NULL)
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 25 * able // 100 THEN rank END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
