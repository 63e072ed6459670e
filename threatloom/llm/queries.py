"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, katz, license_scan, mixing, mpeg_audio, quality_mil, run_detection, simhash, substring_dedup, suffix_dedup, token_files, warc_index
from .shared import WORD, crc_of_id, documents


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(documents(spark, sf_dir))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    # the table has no capture time: captures are a second apart, in order of their ids, and start anew after 200 years
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(6_311_520_000))), "yyyyMMddHHmmss")
    return warc_index.archive_table(pages, stamp)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(documents(spark, sf_dir))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir)).withColumn("passages", F.size("passages").cast("long"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mpeg_audio.media_features(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "frames", "seek_points")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every tenth text, by a hash of its id, made periodic from some word on."""
    docs = docs.select("doc_id", "text", crc_of_id(F.col("doc_id")).alias("h"))
    parts = docs.where("h % 10 <> 0").select("doc_id", "text")
    words = docs.where("h % 10 = 0").withColumns({"w": F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), "g": F.expr("h div 10")})
    words = words.withColumn("n", F.size(F.coalesce("w", F.array().cast("array<string>")))).withColumn("a", F.expr("g % greatest(n, 1)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.expr("CASE WHEN n > 0 THEN array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[CAST(a + (i - a) % p AS INT)] END), ' ') END")
    return parts.unionByName(words.select("doc_id", periodic.alias("text")))


def op12_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_detection.run_report(with_planted_runs(documents(spark, sf_dir)))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_warc_archives": op2_warc_archives,
        "op3_decontaminate": op3_decontaminate,
        "op4_simhash": op4_simhash,
        "op5_katz": op5_katz,
        "op6_source_mix": op6_source_mix,
        "op7_license_scan": op7_license_scan,
        "op8_quality": op8_quality,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_mpeg_audio": op10_mpeg_audio,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_run_detection": op12_run_detection,
        "op13_source_divergence": op13_source_divergence,
        "pipeline": corpus_pipeline.run,
    }


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5.0, 2.0, 1.0][((rk - 1) % 3 + 1)::INT] AS DOUBLE) AS w, source_size * 2.0::DOUBLE AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM sources),
levels AS (
  SELECT *, cap / w AS fill,
         coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_words,
         sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM weighed),
level AS (
  SELECT (budget - full_words) / open_weight AS theta FROM levels WHERE (budget - full_words) / open_weight <= fill ORDER BY fill, rk LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT theta FROM level), cap)) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
by_size AS (
  SELECT source, size, sum(n * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS larger,
         sum(n * size * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS squares
  FROM (SELECT source, CAST(size AS HUGEINT) AS size, CAST(count(*) AS HUGEINT) AS n FROM sized WHERE size > 0 GROUP BY source, size)),
fitting AS (
  SELECT b.source, b.size, CAST(coalesce(larger, 0) AS DOUBLE) AS sure,
         (target - whole * source_size - CAST(coalesce(larger, 0) AS DOUBLE)) / CAST(squares AS DOUBLE) AS factor
  FROM by_size b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source),
factors AS (
  SELECT source, arg_max(factor, size) AS factor, arg_max(sure, size) AS sure FROM fitting WHERE factor * size <= 1 GROUP BY source),
ranked AS (
  SELECT d.doc_id, d.source, d.size, d.u, r.source_size, r.target, r.whole, d.size * coalesce(f.factor, 0.0) AS chance,
         r.target - r.whole * r.source_size - coalesce(f.sure, 0.0) AS rest
  FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN factors f ON d.source IS NOT DISTINCT FROM f.source),
odds AS (
  SELECT *, CASE WHEN chance > 0 AND chance < 1 THEN (u / (1 - u)) * ((1 - chance) / chance) END AS q FROM ranked),
summed AS (
  SELECT *, sum(CASE WHEN q IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size) AS after,
         sum(size) OVER (PARTITION BY source, q, doc_id, size) AS own FROM odds)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN chance >= 1 OR q IS NOT NULL AND after + after - own <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""


OP3_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)),
doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id),
tiny AS (SELECT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM item_words WHERE len(w) BETWEEN 1 AND 4),
tiny_found AS (
  SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, (SELECT DISTINCT k FROM tiny) ks)) JOIN tiny USING (k, s))
SELECT doc_id, item_id, count(*) AS shared, any_value(n_shingles) AS n_shingles, count(*)::DOUBLE / any_value(n_shingles) AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(n_shingles)
UNION ALL SELECT doc_id, item_id, 1, 1, 1e0 FROM tiny_found
"""

OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM starts GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM starts JOIN firsts USING (s) WHERE first_doc < doc_id),
spans AS (
  SELECT doc_id, count(*) AS n_spans FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) WHERE before IS NULL OR before < pos - 1 GROUP BY doc_id),
kept AS (
  SELECT doc_id, list(w[pos] ORDER BY pos) AS kept FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM words) LEFT JOIN gone g USING (doc_id, pos) WHERE g.pos IS NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(len(kept), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM words LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

OP13_SQL = r"""
WITH given AS (
  SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
tokens AS (
  SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM given),
kept AS (SELECT lang, term, count(*) AS total FROM tokens GROUP BY lang, term HAVING count(DISTINCT row_no) >= 3),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY lang, source, term),
pools AS (SELECT DISTINCT lang, source FROM given),
langs AS (SELECT lang, count(*) AS v, sum(total) AS words FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS words FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.words, 0) + l.v) AS p,
         1 + 1000000000::HUGEINT * (k.total + 1) // (l.words + l.v) AS q
  FROM pools g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(sum(CASE WHEN b.p IS NOT NULL THEN (a.p - b.p) * (a.p - b.p) // b.p END), 0) AS value
  FROM pools g JOIN pools h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN shares a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN shares b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
  GROUP BY g.lang, g.source, h.source),
terms AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, CAST(value AS BIGINT), row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM terms)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP11_SQL = r"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT r, b, substr(h, 2 * b + 1, 2398) AS p FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 1000)) AS b FROM given)),
starts AS (
  SELECT r, b + i AS i, md5_number(substr(p, 2 * i + 1, 400)) AS s FROM (SELECT r, b, p, unnest(range(0, least(1000, length(p) // 2 - 199))) AS i FROM pieces)),
repeated AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
edges AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM starts JOIN repeated USING (s)),
runs AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM edges),
spans AS (SELECT r, n, min(i) AS first, max(i) + 199 AS last FROM runs GROUP BY r, n),
gaps AS (
  SELECT r, n, last, coalesce(lead(first) OVER (PARTITION BY r ORDER BY n), -1) AS next, n = 1 AS begins, first FROM spans),
left_over AS (
  SELECT r, string_agg(CASE WHEN begins THEN substr(h, 1, 2 * first) ELSE '' END || substr(h, 2 * last + 3, CASE WHEN next < 0 THEN length(h) ELSE 2 * (next - last - 1) END), '' ORDER BY n) AS k, count(*) AS n_spans, sum(last - first + 1) AS n_removed
  FROM gaps JOIN given USING (r) GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM given LEFT JOIN left_over USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_suffix_dedup": OP11_SQL, "op13_source_divergence": OP13_SQL, "op3_decontaminate": OP3_SQL, "op9_substring_dedup": OP9_SQL, "op6_source_mix": OP6_SQL}
