"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import block_names, curriculum, html_text, line_dedup, media, near_dup, packing, quality, sanitise, shared, token_store


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.summary(shared.table(spark, sf_dir, "pages"))


def op2_progressive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(shared.table(spark, sf_dir, "documents"), with_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_groups(shared.table(spark, sf_dir, "documents"), words_each=2, percent=80)


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = shared.keep(curriculum.mix(shared.table(spark, sf_dir, "documents")), "mix")
    ordered = mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_groups(shared.table(spark, sf_dir, "documents"))


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.sanitise(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op7_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(shared.table(spark, sf_dir, "documents"), path, longest=1024, end_id=0, with_ids=False, in_file_order=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(shared.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"), threshold=0.7)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "token-store")
    token_store.write(shared.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.verify(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_progressive_media,
        op3_near_dedup,
        op4_mix_to_targets,
        op5_exact_dedup,
        op6_disclosure,
        op7_pack_binary,
        op8_line_dedup,
        op9_quality,
        op10_token_store,
    )
}

_SPACE = r"[\x20\x09-\x0D]"

ORACLES: dict[str, str] = {
    "op5_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY body)""",
    "op4_mix_to_targets": rf"""
        WITH d AS (
            SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS turn,
                   len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '')) AS size
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (SELECT *, 3 * source_size AS cap, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
                        CASE nth % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS ramp FROM s),
        l AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                      / sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT arg_min(level, (cap / weight, nth)) AS level FROM l WHERE level * weight < cap),
        t AS (
            SELECT source, source_size, ramp,
                   CASE WHEN f.level IS NULL OR cap / weight <= f.level THEN CAST(cap AS DOUBLE) ELSE f.level * weight END AS target
            FROM w CROSS JOIN f),
        p AS (
            SELECT doc_id, size, source_size, target, ramp,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
                   CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (
            SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN 2 * start + size <= 2 * (target - passes * source_size) THEN 1 ELSE 0 END END AS copies,
                   least(1.0::DOUBLE, start / target) AS share
            FROM p)
        SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken,
               round(CASE WHEN copies = 0 THEN NULL WHEN ramp = 0 THEN share
                          ELSE (1 + ramp - sqrt(greatest(0.0::DOUBLE, (1 + ramp) * (1 + ramp) - 4 * ramp * share))) / (2 * ramp) END, 9) + 0.0 AS position
        FROM c""",
}
