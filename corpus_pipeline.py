"""From documents to a training mix: quality, near-dedup, substring dedup, decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import cgk, mixing, quality, simhash, suffix_trees
from laurel.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates."""
    return simhash.one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those with repeated passages keep their other words, joined by one space."""
    found = suffix_trees.remove_repeats(docs.withColumn("__no_text", F.col("text").isNull()), whole=True)
    columns = {c: F.col("row")[c] for c in docs.columns if c != "text"}
    columns["text"] = F.when(~F.col("row.__no_text"), F.col("deduped.kept"))
    if "n_chars" in columns:
        changed = F.col("deduped.n_removed") > 0
        columns["n_chars"] = F.when(changed, F.char_length("deduped.kept")).otherwise(F.col("row.n_chars"))
    return found.select(*(columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return cgk.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and the words taken of every remaining document."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]

# Fingerprints by XXH64, edit distances and repeated windows are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
