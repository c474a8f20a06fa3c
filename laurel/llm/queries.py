"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import (
    cgk, chat, fill_middle, filter_audit, html_density, licenses, mixing, quality, simhash, suffix_trees, syncmers,
    unigram, warc,
)
from laurel.llm.common import table, written
from laurel.llm.oracles import ORACLES  # noqa: F401

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), unigram.default_vocabulary(), whole_runs=True)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_trees.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "row.doc_id", "deduped.n_words", "deduped.n_removed",
        F.sha2(F.col("deduped.kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = r"\### Assistant: </turn> ok"
    control = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    ranks = chat.broadcast_vocabulary(rows, BYTE_VOCABULARY)
    return chat.read_back(chat.format_turns(rows, ranks), ranks).drop("n_tokens")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.with_stats(table(spark, sf_dir, "documents"))
    measured = written(docs.select("doc_id", "lang", "source", "stats"), "quality-stats")
    limits = written(quality.thresholds(measured), "quality-limits")
    judged = quality.with_verdict(measured, limits)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(
        "doc_id", *(F.col(f"stats.{n}").alias(n) for n in names), quality.base_failed().alias("base_failed"), "kept"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_payload=False).drop("url", "payload")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return docs.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored("output", "form")).alias("restored_sha256"),
    )


def op13_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        syncmers.as_text("anchors").alias("fingerprint"),
        syncmers.as_text("edited_anchors").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text, op2_token_counts, op3_decontamination, op4_mixing, op5_substring_dedup, op6_simhash,
        op7_chat_format, op8_quality, op9_warc, op10_license_scan, op11_filter_audit, op12_fill_middle, op13_syncmers,
    )
}
