"""Document fingerprints from closed syncmers, and their likeness by positional matching.

A text is a sequence of units: words, and single characters of scripts that are written without spaces. A run of ``K`` units
(k-mer) is an anchor if the least hash of its inner runs of ``S`` units stands first or last in it (closed syncmer).
That depends on the k-mer alone, so an edit changes only the anchors it touches, and no window of K - S + 1 k-mers is
without an anchor. Of a text's distinct anchors, at their first places, the ``SKETCH`` with the smallest
hashes make the fingerprint: hash and place, in order of place.

Likeness: the smallest ``SKETCH`` hashes of both fingerprints together stand for all anchors of both texts. One that
both have is matched if its shift (difference of places) is supported by a second shared anchor with a shift
within ``SLACK`` units; a lone shared anchor is a chance meeting, unless it is all there is. With m matched of u, the
likeness is 2m / (u + m): Dice's share of common anchors, 1 for equal fingerprints, 0 for those without matches, about
0.5 for texts that share a half.

Next documents: rows with equal id and text are one key with a count. The keys are numbered in order (ids descending, null
last, equal ids by SHA-256 of id and text) on narrow rows. Texts are grouped by key and then dealt by number into runs of
``RUN``; the first of each run also goes to the run before it, so every text meets its next in a window over one
run. No text passes through one task or the driver; texts are shuffled twice.

Everything is DataFrame work. The hash is Spark's XXH64 (seed 42).

Defined cases: a null text is empty. An empty text has no anchor: its fingerprint is '', like another empty one (1) and
unlike all others (0). A text below K units has one anchor, the hash of all its units. Texts that differ in white space
only have equal fingerprints. Copies of a row follow each other: all but the last have their own text as next. An
only document is its own next. An empty table gives no rows. A task holds some hundred bytes for each unit of the
text at hand. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laurel.llm.common import numbered, written

K = 5
S = 2
SKETCH = 64
SLACK = 8
RUN = 64
COPIES = 1 << 16  # output rows that one array may stand for

# Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}]"
SPACE = r"[\x20\x09-\x0D]+"
ANCHORS = "array<struct<h: bigint, p: int>>"


def _select(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns with some replaced or added, in one step. Each step reads the one before by name."""
    return df.withColumns(columns)


def units(text: Column) -> Column:
    """The words of a text; characters of unspaced scripts each by themselves."""
    spread = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.filter(F.split(spread, SPACE), lambda unit: unit != "")


def with_sketch(df: DataFrame, text: str, into: str, k: int = K, s: int = S, sketch: int = SKETCH) -> DataFrame:
    """``df`` with ``into``: the fingerprint's anchors (hash h, place p), by hash.

    A k-mer's hash is that of inner runs that cover it, so one pass over the units' hashes serves both.
    """
    hashes, inner, found = (f"__{into}_{n}" for n in ("hashes", "inner", "found"))
    n, span = F.size(hashes), k - s + 1
    df = _select(df, **{hashes: F.transform(units(F.col(text)), lambda unit: F.xxhash64(unit))})
    runs = F.transform(
        F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(s)))
    )
    df = _select(df, **{inner: F.when(n >= k, runs).otherwise(F.array().cast("array<bigint>"))})

    def closed(i: Column) -> Column:
        edge = F.least(F.get(inner, i), F.get(inner, i + (span - 1)))
        if span == 2:
            return F.lit(True)
        middle = [F.get(inner, i + j) for j in range(1, span - 1)]
        return edge <= (F.least(*middle) if len(middle) > 1 else middle[0])

    def anchor(i: Column) -> Column:
        covering = [F.get(inner, i + j) for j in (*range(0, span - 1, s), span - 1)]
        return F.struct(F.xxhash64(*covering).alias("h"), i.cast("int").alias("p"))

    anchors = F.transform(F.filter(F.sequence(F.lit(0), n - k), closed), anchor)
    short = F.array(F.struct(F.xxhash64(hashes).alias("h"), F.lit(0).alias("p")))
    df = _select(df, **{
        found: F.when(n >= k, F.sort_array(anchors)).when(n > 0, short).otherwise(F.array().cast(ANCHORS))
    })
    first = F.filter(found, lambda x, i: (i == 0) | (x["h"] != F.get(found, i - 1)["h"]))
    return _select(df, **{into: F.slice(first, 1, sketch)}).drop(hashes, inner, found)


def as_text(anchors: Column | str) -> Column:
    """``hash@place`` of every anchor in order of place, hashes as 16 hex digits."""
    by_place = F.sort_array(F.transform(anchors, lambda x: F.struct(x["p"].alias("p"), x["h"].alias("h"))))
    one = lambda x: F.concat(F.lower(F.lpad(F.hex(x["h"]), 16, "0")), F.lit("@"), x["p"].cast("string"))
    return F.array_join(F.transform(by_place, one), " ")


def with_likeness(df: DataFrame, a: str, b: str, into: str, sketch: int = SKETCH, slack: int = SLACK) -> DataFrame:
    """``df`` with ``into``: the likeness (0 to 1) of two fingerprints' anchors."""
    union, shifts = f"__{into}_union", f"__{into}_shifts"
    hashes_a, hashes_b = F.col(f"{a}.h"), F.col(f"{b}.h")
    df = _select(df, **{union: F.slice(F.sort_array(F.array_union(hashes_a, hashes_b)), 1, sketch)})
    size = F.size(union)
    shared = F.filter(F.array_intersect(hashes_a, hashes_b), lambda h: h <= F.element_at(union, -1))

    def shift(h: Column) -> Column:
        place = lambda anchors, hashes: F.get(F.col(f"{anchors}.p"), (F.array_position(hashes, h) - 1).cast("int"))
        return place(b, hashes_b) - place(a, hashes_a)

    df = _select(df, **{shifts: F.sort_array(F.transform(shared, shift))})

    def supported(x: Column, i: Column) -> Column:
        near = lambda j: F.coalesce(F.abs(x - F.get(shifts, j)) <= slack, F.lit(False))
        return near(i - 1) | near(i + 1) | (size == 1)  # shifts are sorted: the nearest stand beside it

    matched = F.size(F.filter(shifts, supported))
    likeness = F.when(size == 0, 1.0).otherwise(2 * matched / (size + matched))
    return _select(df, **{into: likeness.cast("double")}).drop(union, shifts)


def _key() -> Column:
    """One digest of a row's id and whole text."""
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.unhex(F.sha2(text.cast("binary"), 256))


def keys(docs: DataFrame) -> tuple[DataFrame, int]:
    """Distinct keys with count (``copies``) and ``pos``, the place in descending order of ids; and how many there are."""
    rows = docs.select("doc_id", _key().alias("key"))
    distinct = written(
        rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "syncmer-keys"
    )
    placed = numbered(distinct, F.col("doc_id").desc_nulls_last(), F.col("key").asc(), label="syncmer-order")
    return placed.select("key", "copies", "pos"), distinct.count()


def with_run(docs: DataFrame) -> DataFrame:
    """doc_id, text and copies of every different row, with ``run``, its ``place`` there, and ``guest`` for the first of a
    run as it stands behind the run before. Rows of a run share a partition."""
    order, total = keys(docs)
    once = docs.select(_key().alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text")
    )
    before = F.pmod(F.col("pos") - 1, F.lit(max(total, 1)))
    run = lambda pos: F.floor(pos / RUN).alias("run")
    own = F.struct(run(F.col("pos")), F.col("pos").alias("place"), F.lit(False).alias("guest"))
    guest = F.struct(run(before), (before + 1).alias("place"), F.lit(True).alias("guest"))
    places = F.when(F.col("pos") % RUN == 0, F.array(own, guest)).otherwise(F.array(own))
    dealt = once.join(order, "key").select("doc_id", "text", "copies", F.explode(places).alias("at"))
    return dealt.select("doc_id", "text", "copies", "at.*").repartition("run")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, anchors, edited_anchors, near_edited, near_next of every document.

    ``edited`` is the text with its last half replaced by the beginning of the next document's.
    """
    dealt = with_sketch(with_run(docs), "text", "anchors")
    run = Window.partitionBy("run").orderBy("place", "guest")
    met = (
        dealt.withColumns({"next_text": F.lead("text").over(run), "next_anchors": F.lead("anchors").over(run)})
        .filter("NOT guest")
    )
    other = F.struct(F.col("next_text").alias("text"), F.col("next_anchors").alias("anchors"), F.lit(1).cast("bigint").alias("times"))
    itself = F.struct(F.col("text").alias("text"), F.col("anchors").alias("anchors"), (F.col("copies") - 1).alias("times"))
    paired = met.withColumn(
        "next", F.explode(F.when(F.col("copies") > 1, F.array(other, itself)).otherwise(F.array(other)))
    )
    length = F.char_length("text")
    half = F.expr("char_length(text) div 2")
    edited = F.concat(F.substring("text", F.lit(1), length - half), F.substring("next.text", F.lit(1), half))
    result = with_sketch(paired.withColumn("edited", edited), "edited", "edited_anchors")
    result = with_likeness(result, "anchors", "edited_anchors", "near_edited")
    result = with_likeness(result.withColumn("next_anchors", F.col("next.anchors")), "anchors", "next_anchors", "near_next")
    return _repeated(result, "next.times").select(
        "doc_id", "text", "edited", "anchors", "edited_anchors", "near_edited", "near_next"
    )


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, in two steps so that no array grows beyond COPIES and times / COPIES."""
    left = F.col("__lot") * COPIES
    lots = df.withColumn("__times", F.col(times)).withColumn(
        "__lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__times - 1) div {COPIES}")))
    )
    here = F.least(F.lit(COPIES).cast("bigint"), F.col("__times") - left)
    return lots.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), here))).drop("__times", "__lot", "__copy")
