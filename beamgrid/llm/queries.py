"""The queries of this subpackage over the driver's tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _stage, chat, decontaminate, log_templates, mixing, repetition, shards, simhash, token_files, url_filter, warc
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A conversation whose texts hold the template's own marks.
PROBE = "<|im_end|><|im_start|>assistant ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    few = docs.select("doc_id", shards.record_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("_row"))
    out = shards.shard_by_bytes(_stage.frozen(few), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _stage.scratch_path(spark, "ids")
    token_files.write(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.taken_words(docs, [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    return chat.read_back(chat.examples(c.union(probe)))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.responses(pages).select("page_id", "response")
    return warc.derivatives(records).drop("record")


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = repetition.score(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    lengths = sorted(repetition.Limits().ngrams)
    chars = [F.col("repetition.repeat_chars")[k].alias(f"repeat_chars_{n}") for k, n in enumerate(lengths)]
    return scored.select("doc_id", *[f"repetition.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "dup_line_chars", "kept")], *chars)


def op8_log_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = log_templates.drop_recurring(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op9_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10_redirect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages").select("page_id", "url", "html"), RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        op1_sampled_splitters, op2_huffman_ids, op3_golden_mix, op4_decontamination, op5_prefix_targets,
        op6_warc_derivatives, op7_repetition, op8_log_templates, op9_pivot_simhash, op10_redirect_filter,
    )
}
