"""Filter interaction audit over a sparse document-term matrix.

Five filters (A: few words, B: few distinct words, C: capitals, D: symbols, E: copy of a document with a smaller id) are
applied in all 120 orders. The audit says, for each part of the corpus, order and step, what the filter keeps, removes,
would have removed, and how much good or toxic text goes.

1. Shards: every task cuts its documents into shards of up to ``SHARD_BYTES`` of text, splits their words, codes them
   by a dictionary of the shard's own, and emits one row a shard: a CSR matrix (row ends, columns, counts, each packed
   as bytes, see ``unpacked``) with the shard's word list, and per document its id, part, SHA-256 and the flags that need characters (C, D).
2. Dictionary: the words of all shards are dealt by hash into ``BUCKETS``; inside a bucket the distinct words are numbered in
   order, and number and bucket make the word's global number (number * BUCKETS + bucket, so numbers are used without gaps
   but for the uneven ends of the buckets). A word comes once a shard, never once a text, so even a word of every text is
   a small part of its bucket. No task and no driver holds the dictionary.
3. Encoding: the numbered words go back to their shards, whose columns become global, in ascending order within a row. Row
   sums are the numbers of words, nonzero counts those of distinct words: they decide A and B.
4. E compares a document's id with the smallest id of its digest; labels are reduced to one row an id.
5. Each part has at most 32 different sets of failed filters. Their counts give all 600 rows of a part: a document is
   removed by the first filter of the order that it fails. Of the 120 orders, each of the j filters that a document fails
   comes first among them in 120 / j, which is the Shapley count.

Defined cases: a null text is empty; an empty text fails A only (0 is not below 0, no character is a capital), and E if it
has an elder copy. A null language is the part ''. A null id has no smaller id and is none, and has no labels. Rows with
equal ids and texts are not smaller than each other, so they pass E. Several label rows of an id count as one that has
what any of them has. An empty table gives no parts and no rows. Long texts make a shard of their own. Only the
columns doc_id, text and lang, and doc_id, quality and toxic of the labels, are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from laurel.llm.common import utf8, written

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
SHARD_BYTES = 16 << 20
BUCKETS = 1 << 20
LOCAL, GLOBAL = "<i4", "<i8"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_A, _B, _C, _D, _E = (1 << i for i in range(5))
_CAPITAL = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_CONTINUES = (np.arange(256) & 0xC0) == 0x80  # bytes inside a code point

SHARD = (
    "shard bigint, part array<string>, doc_id array<bigint>, digest array<binary>, flags array<int>, "
    "row_end binary, columns binary, counts binary, words array<string>"
)
_SHARD = pa.schema([
    ("shard", pa.int64()), ("part", pa.list_(pa.string())), ("doc_id", pa.list_(pa.int64())),
    ("digest", pa.list_(pa.binary())), ("flags", pa.list_(pa.int32())), ("row_end", pa.binary()),
    ("columns", pa.binary()), ("counts", pa.binary()), ("words", pa.list_(pa.string())),
])


def _hits(marked: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie between each two following ends."""
    return np.diff(np.searchsorted(np.flatnonzero(marked), ends))


def character_flags(texts: pa.LargeStringArray) -> np.ndarray:
    """The filters C and D of every text, as bits."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    characters = np.diff(ends) - _hits(_CONTINUES[data], ends)
    capitals = _hits(_CAPITAL[data], ends)
    symbols = _hits(_SYMBOL[data], ends)
    return _C * (100 * capitals > MAX_CAPITAL_PERCENT * characters) + _D * (symbols > 0)


def local_matrix(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(end of each row, columns, counts, words) of the texts' matrix; columns are places in ``words``."""
    split = pc.ascii_split_whitespace(texts)
    words, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    there = pc.greater(pc.binary_length(words), 0)
    coded = words.filter(there).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    size = max(len(coded.dictionary), 1)
    cells = rows.filter(there).to_numpy().astype(np.int64) * size + coded.indices.to_numpy()
    cells, counts = np.unique(cells, return_counts=True)
    row_end = np.cumsum(np.bincount(cells // size, minlength=len(texts)))
    return row_end, cells % size, counts, coded.dictionary


def packed(values: np.ndarray, kind: str = LOCAL) -> pa.Array:
    """A column of a matrix as one value: integers of 32 bits in a shard of its own, else of 64, all their lowest bytes
    first, then all the next ones: the higher bytes of ascending columns and of counts then compress well."""
    numbers = values.astype(kind)
    planes = numbers.view(np.uint8).reshape(-1, numbers.itemsize).T
    return pa.array([planes.tobytes()], pa.binary())


def unpacked(value: bytes, kind: str = GLOBAL) -> np.ndarray:
    planes = np.frombuffer(value, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return planes.T.copy().view(kind).ravel()


def _one(kind: pa.DataType, values, integers: str = LOCAL) -> pa.Array:
    """A list array with one list, or one packed value."""
    if kind == pa.binary():
        return packed(values, integers)
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind.value_type))


def _shard_row(number: int, docs: pa.Table) -> pa.RecordBatch:
    texts = docs["text"].cast(pa.large_string()).combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    row_end, columns, counts, words = local_matrix(texts)
    lists = [
        *(pa.concat_arrays(docs[name].chunks) for name in ("part", "doc_id", "digest")),
        character_flags(texts), row_end, columns, counts, words,
    ]
    kinds = [field.type for field in _SHARD][1:]
    columns = [pa.array([number]), *(_one(kind, values) for kind, values in zip(kinds, lists, strict=True))]
    return pa.RecordBatch.from_arrays(columns, schema=_SHARD)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        first = 0
        for row, length in enumerate(lengths):
            if size and size + length > SHARD_BYTES:
                yield _shard_row(number, pa.Table.from_batches([*held, batch.slice(first, row - first)]))
                number, held, size, first = number + 1, [], 0, row
            size += int(length)
        held.append(batch.slice(first))
    if sum(map(len, held)):
        yield _shard_row(number, pa.Table.from_batches(held))


def shards(docs: DataFrame) -> DataFrame:
    """Stored CSR shards of ``docs`` with dictionaries of their own (see SHARD).

    Shards are large rows: Arrow batches are kept to about one by lowering the session's bytes for a batch.
    """
    conf = docs.sparkSession.conf
    conf.set(BATCH_BYTES, min(int(conf.get(BATCH_BYTES).rstrip("b")), SHARD_BYTES))
    rows = docs.select(
        F.coalesce("lang", F.lit("")).alias("part"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(utf8("text"), 256)).alias("digest"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return written(rows.mapInArrow(_shards, SHARD), "audit-shards")


def numbered_words(shard_rows: DataFrame) -> DataFrame:
    """(shard, place, word, number): the global number of every word of every shard."""
    own = shard_rows.select("shard", F.posexplode("words").alias("place", "word"))
    dealt = own.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    order = Window.partitionBy("bucket").orderBy("word")
    number = (F.dense_rank().over(order) - 1).cast("bigint") * BUCKETS + F.col("bucket")
    return dealt.select("shard", "place", "word", number.alias("number"))


def dictionary(shard_rows: DataFrame) -> DataFrame:
    """(word, number): every word of the corpus."""
    return numbered_words(shard_rows).select("word", "number").distinct()


_MATRIX = ("row_end", "columns", "counts")
_PER_ROW = ("part", "doc_id", "digest", "flags")


def _global(schema: pa.Schema, matrix: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row_end, columns, counts = (unpacked(batch.column(name)[i].as_py(), LOCAL) for name in _MATRIX)
                ids = np.zeros(len(columns), np.int64)  # a shard has no more words than cells
                if (pairs := batch.column("pairs")[i].values) is not None:
                    place, number = pairs.flatten()
                    ids[place.to_numpy()] = number.to_numpy()
                rows = np.repeat(np.arange(len(row_end)), np.diff(row_end, prepend=np.int32(0)))
                columns = ids[columns]
                order = np.lexsort((columns, rows))
                columns, counts = columns[order], counts[order]
                sums = np.bincount(rows, weights=counts, minlength=len(row_end)).astype(np.int64)
                nonzero = np.bincount(rows[counts > 0], minlength=len(row_end))
                lists = {"row_sum": sums, "row_nonzero": nonzero}
                if matrix:
                    lists |= {"row_end": row_end, "columns": columns, "counts": counts}
                arrays = [
                    _one(field.type, lists[field.name], GLOBAL) if field.name in lists else batch.column(field.name).slice(i, 1)
                    for field in schema
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def global_shards(shard_rows: DataFrame, matrix: bool = True) -> DataFrame:
    """The shards with columns numbered by the whole corpus, and each row's sum and nonzero count.

    ``matrix=False`` leaves out the cells, where only the totals are wanted.
    """
    ids = (
        numbered_words(shard_rows)
        .groupBy("shard")
        .agg(F.collect_list(F.struct("place", "number")).alias("pairs"))  # as many as the shard has words
    )
    known = shard_rows.drop("words").join(ids, "shard", "left")
    kinds = {f.name: f.type for f in _SHARD} | {"row_sum": pa.list_(pa.int64()), "row_nonzero": pa.list_(pa.int64())}
    names = ["shard", *_PER_ROW, "row_sum", "row_nonzero", *(_MATRIX if matrix else ())]
    schema = pa.schema([(n, kinds[n]) for n in names])
    sql = {f.name: f.dataType.simpleString() for f in shard_rows.schema}
    sql |= {"row_sum": "array<bigint>", "row_nonzero": "array<bigint>"}
    return known.mapInArrow(_global(schema, matrix), ", ".join(f"{n} {sql[n]}" for n in names))


def failed_filters(docs: DataFrame) -> DataFrame:
    """part, doc_id and ``failed`` (bits of the filters A to E, as numbers 1, 2, 4, 8, 16) of every document."""
    local = shards(docs)
    totals = global_shards(local, matrix=False)
    names = (*_PER_ROW, "row_sum", "row_nonzero")
    each = totals.select(F.explode(F.arrays_zip(*names)).alias("row")).select("row.*")
    few = F.when(F.col("row_sum") < MIN_WORDS, _A).otherwise(0)
    same = F.when(100 * F.col("row_nonzero") < MIN_DISTINCT_PERCENT * F.col("row_sum"), _B).otherwise(0)
    bits = (F.col("flags") + few + same).cast("int").alias("bits")
    rows = written(each.select("part", "doc_id", "digest", bits), "audit-rows")
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copies = written(firsts.filter("n > 1").select("digest", "first_id"), "audit-copies")  # stored: Spark can split the join
    copy = F.when(F.col("doc_id") > F.col("first_id"), _E).otherwise(0)
    return rows.join(copies, "digest", "left").select("part", "doc_id", (F.col("bits") + copy).alias("failed"))


def _total(field: str, holds: Callable[[Column], Column]) -> Column:
    """The sum of ``field`` over the part's sets of failed filters for which ``holds``."""
    add = lambda acc, x: acc + F.when(holds(x["failed"]), x[field]).otherwise(F.lit(0))
    return F.aggregate("sets", F.lit(0).cast("bigint"), add)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows for every part: part, filter_order, step and the counts (see the module's text)."""
    marks = labels.groupBy(F.col("doc_id").alias("__id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    counted = (
        failed_filters(docs)
        .join(marks, F.col("doc_id") == F.col("__id"), "left")
        .groupBy("part", "failed")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    )
    sets = counted.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = sets.withColumn("filter_order", F.explode(orders)).withColumn(
        "step", F.explode(F.array(*(F.lit(i + 1) for i in range(len(FILTERS)))))
    )
    earlier = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    bit = F.element_at(F.array(*(F.lit(1 << i) for i in range(5))), F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - 64)
    before = sum((F.when(F.contains(earlier, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    placed = steps.withColumn("bit", bit).withColumn("before", before)
    fails = lambda m: m.bitwiseAND(F.col("bit")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    shapley = lambda acc, x: acc + F.when(
        fails(x["failed"]), x["n"] * F.expr("120L") / F.bit_count(x["failed"])
    ).otherwise(F.lit(0))
    return placed.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        _total("n", lambda m: m.bitwiseAND(F.col("bit").bitwiseOR(F.col("before"))) == 0).alias("kept"),
        _total("n", removed).alias("removed"),
        _total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        _total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        F.aggregate("sets", F.lit(0.0), shapley).cast("bigint").alias("shapley"),
    )
