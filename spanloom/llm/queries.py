"""The thin queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, exact_dedup, line_dedup, mixing, quality, sharding, simhash_dedup, token_counts, warc, wavelet
from spanloom.llm.common import fresh_path, raw_table, text_or_empty, written

N_SHARDS = 8


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", "quality.*")


def tokenizer_path() -> str:
    """The vocabulary file; it must be at this place on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_table(spark, sf_dir, "documents").select("text")
    return token_counts.suffix_sums(written(token_counts.length_histogram(docs, tokenizer_path()), "lengths"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_or_empty("text")
    slim = raw_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    placed = sharding.feistel_shards(slim, [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")], N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(mixing.slim_sizes(raw_table(spark, sf_dir, "documents")))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.near_groups(raw_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "warc")
    warc.write_warc(raw_table(spark, sf_dir, "pages"), target, "page_id", "html", "url")
    records = warc.read_warc(spark, target)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    response = F.col("record_type") == "response"
    return records.select(
        number("record_id").alias("page_id"),
        F.when(response, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, warc.base32_sha1(F.col("payload"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_codec(docs, tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "tokens")
    wavelet.write_tokens(raw_table(spark, sf_dir, "documents"), tokenizer_path(), target)
    docs = wavelet.read_tokens(spark, target)
    looked_up = [F.col("first_id"), F.col("n_wanted").alias("n_end_ids"), F.col("first_wanted").alias("first_end")]
    slim = written(docs.select("part", "piece", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"), *looked_up), "token-docs")
    return wavelet.with_starts(slim).select("doc_id", "start", "n_tokens", "ids_crc32", "first_id", "n_end_ids", "first_end")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = line_dedup.line_dedup(docs, shingles=line_dedup.SHINGLES)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return clean.select("doc_id", lines.alias("n_lines"), F.col("clean_text_dropped").alias("n_dropped"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(raw_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mixing": _MIXING,
        "op10_exact_dedup": _EXACT,
    }


#: Capped shares in closed form: by rising cap / weight the first k sources are capped, and the rest share what is left.
_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 AS weight FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k, sum(source_size) OVER () AS total FROM w
), c AS (
  SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM o
), f AS (
  SELECT rest, open_weight FROM c WHERE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(open_weight AS DOUBLE) <= 3 * source_size ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(CAST(weight AS DOUBLE) * CAST(f.rest AS DOUBLE) / CAST(f.open_weight AS DOUBLE), CAST(3 * source_size AS DOUBLE)) AS target FROM w, f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""

_EXACT = r"""
WITH n AS (
  SELECT doc_id, row_number() OVER () AS i, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, i) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST, i) = 1 AS kept,
       text_sha256
FROM n
"""
