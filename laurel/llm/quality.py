"""Quality rules with thresholds that adapt to each language and source.

Method: every measure of a document falls into a bucket of a quantile sketch whose bucket limits are fixed
(one bucket per integer below 512, then 256 buckets per power of two, so a quantile is off by less than 0.4 %).
Sketches are bucket counts: they merge by addition, in any order, with the same result. From its sketch each
(language, source) reads the limits ``upper + reach * max(upper - median, 1)``, where ``upper`` is a high quantile
(``TAILS``: 90 % where junk is a mode of its own, 99 % where clean texts have a long tail), and for the mean word length
also the mirrored lower limit. A limit is then drawn towards that of the language, and the language's towards that of
all documents, as if ``PARENT_DOCS`` documents of the larger group were mixed in: a small group follows its parent, a
large one itself, with no switch between. The limits are joined to the documents and filter them. A group of which over
a tenth is junk widens its own limits; that is the price of limits that follow a source.

Measures (integers, so that sketches and limits are exact): symbols per mille of word characters, repeated
lines per mille of lines with a word, repeated words per mille of words, mean word length in hundredths.

Defined cases: a null or empty text has no words and fails the base rule. Null languages and sources are groups
of their own. Equal rows are counted and judged each. An empty table gives an empty result. Only the columns
named in the arguments are read; others pass through untouched.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laurel.llm.common import per_text, utf8, written

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
PARENT_DOCS = 200
# measure -> upper quantile in per cent, and how often its distance from the median is added
TAILS = {"symbols": (90, 1), "dup_lines": (99, 1), "repeats": (99, 1), "word_length": (90, 3)}
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
_STATS = pa.struct([(part.split()[0], pa.int64()) for part in STATS.split(", ")])


def text_stats(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated triples, lines with a word."""
    words = text.split()
    letters = b"".join(words).decode()
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    return (
        len(words),
        len(letters),
        len(text) - len(text.translate(None, SYMBOLS)),
        dup_lines,
        repeated_words(words),
        lines,
    )


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by a window of ``size`` words that occurs at least twice."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = end = 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + size - max(start, end)
            end = start + size
    return covered


stats_udf = per_text(text_stats, _STATS)


def with_stats(docs: DataFrame, text: str = "text", into: str = "stats") -> DataFrame:
    """``docs`` with a struct column of counts over each whole text."""
    return docs.withColumn(into, stats_udf(utf8(text)))


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEATED_PERCENT * s["n_words"])


def measures(stats: str = "stats") -> dict[str, Column]:
    s = F.col(stats)

    def ratio(part: Column, whole: Column, unit: int) -> Column:
        return F.floor(unit * part / F.greatest(whole, F.lit(1)))

    return {
        "symbols": ratio(s["n_symbols"], s["word_chars"], 1000),
        "dup_lines": ratio(s["n_dup_lines"], s["n_lines"], 1000),
        "repeats": ratio(s["n_repeat_words"], s["n_words"], 1000),
        "word_length": ratio(s["word_chars"], s["n_words"], 100),
    }


def bucket(value: Column) -> Column:
    """Lower limit of the sketch bucket that holds ``value``."""
    shift = F.greatest(F.length(F.bin(value)) - 9, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(docs: DataFrame, stats: str = "stats", lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts (g_lang, g_source, measure, bucket, n) of all documents that pass the base rule."""
    cells = F.array(*(F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in measures(stats).items()))
    return (
        docs.filter(~base_failed(stats))
        .select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), F.explode(cells).alias("cell"))
        .groupBy("g_lang", "g_source", "cell.measure", "cell.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group (``keys``): number of documents and its own limits of each measure. Windows hold a group's buckets."""
    order = Window.partitionBy(*keys, "measure").orderBy("bucket")
    whole = Window.partitionBy(*keys, "measure")
    placed = sketch.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(whole))

    def quantile(percent: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket")))

    levels = {100 - upper for upper, _ in TAILS.values()} | {upper for upper, _ in TAILS.values()} | {50}
    read = placed.groupBy(*keys, "measure").agg(
        F.max("total").alias("n_docs"), *(quantile(level).alias(f"q{level}") for level in sorted(levels))
    )
    columns = [F.max("n_docs").alias("n_docs")]
    for name, (upper, reach) in TAILS.items():
        high, low, middle = F.col(f"q{upper}"), F.col(f"q{100 - upper}"), F.col("q50")
        most = high + reach * F.greatest(high - middle, F.lit(1))
        columns.append(F.max(F.when(F.col("measure") == name, most)).alias(f"{name}_most"))
        if name == "word_length":
            least = low - reach * F.greatest(middle - low, F.lit(1))
            columns.append(F.max(F.when(F.col("measure") == name, least)).alias(f"{name}_least"))
    return read.groupBy(*keys).agg(*columns)


def drawn(own: Column, n_docs: Column, parent: Column) -> Column:
    """A group's limit after ``PARENT_DOCS`` documents of its parent are mixed in."""
    return F.floor((n_docs * own + PARENT_DOCS * parent) / (n_docs + PARENT_DOCS))


def thresholds(docs: DataFrame, stats: str = "stats", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source): its limits, drawn towards those of its language and of all documents."""
    sketch = written(sketches(docs, stats, lang, source), "quality-sketch")
    own = limits(sketch, "g_lang", "g_source")
    names = [c for c in own.columns if c not in ("g_lang", "g_source", "n_docs")]
    overall = limits(merged(sketch)).first()  # one row of limits
    by_lang = limits(merged(sketch, "g_lang"), "g_lang").select(
        F.col("g_lang").alias("p_lang"),
        *(drawn(F.col(c), F.col("n_docs"), F.lit(overall[c])).alias(f"p_{c}") for c in names),
    )
    joined = own.join(by_lang, F.col("g_lang").eqNullSafe(F.col("p_lang")))
    picked = (drawn(F.col(c), F.col("n_docs"), F.col(f"p_{c}")).alias(c) for c in names)
    return joined.select("g_lang", "g_source", *picked)


def with_verdict(
    docs: DataFrame, limits_table: DataFrame, stats: str = "stats", lang: str = "lang", source: str = "source",
    into: str = "kept",
) -> DataFrame:
    """``docs`` with ``into``: passes the base rule and lies within its group's limits."""
    names = [c for c in limits_table.columns if c not in ("g_lang", "g_source")]
    packed = limits_table.select(
        F.col("g_lang").alias("__lang"), F.col("g_source").alias("__source"), F.struct(*names).alias("__limits")
    )
    value = measures(stats)
    within = F.lit(True)
    for name in TAILS:
        within = within & (value[name] <= F.col(f"__limits.{name}_most"))
    within = within & (value["word_length"] >= F.col("__limits.word_length_least"))
    return (
        docs.join(packed, docs[lang].eqNullSafe(F.col("__lang")) & docs[source].eqNullSafe(F.col("__source")), "left")
        .withColumn(into, ~base_failed(stats) & F.coalesce(within, F.lit(False)))
        .drop("__lang", "__source", "__limits")
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``."""
    with_counts = with_stats(docs, into="__stats")
    limits_table = written(thresholds(with_counts, "__stats"), "quality-limits")
    return with_verdict(with_counts, limits_table, "__stats", into="__kept").filter("__kept").select(*docs.columns)
