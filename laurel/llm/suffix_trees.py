"""Exact substring dedup with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. A window is repeated if its word sequence also starts anywhere
else, in the same or another document; words covered by a repeated window are removed, all judged on the input.

Method. Suffixes of the word sequences are split by prefix into groups that fit into memory, and each group's suffix
tree tells which suffixes share a node at depth ``WINDOW`` or more.

1. Prefixes. The suffixes of a window all hang together by the window's *anchor*: its least ``PREFIX``-word
   sequence by hash, the leftmost of equals. Equal windows have equal anchors at equal places, so
   windows are grouped by anchor, and neighbouring windows with one anchor travel as one *occurrence*.
2. Frequencies. A first pass counts each anchor and compares the spans of its occurrences by hash. An anchor
   that occurs once has a lone leaf and is dropped. If all spans of an anchor are equal, its subtree is one path whose
   leaves all lie below depth ``WINDOW``: all its windows are repeated, nothing need be built.
3. Subtrees. The other anchors' occurrences fetch their words. Groups of at most ``GROUP`` occurrences are
   grown word by word in one task; branches with one leaf end at once. For larger groups the prefix is extended, by half
   a window and then to the whole, where a subtree is a single node and its leaves are counted by partial aggregation.
4. The words below deep nodes are dropped from their documents.

Defined cases: null and empty texts have no words and stay as they are. Equal rows are separate documents, so they
repeat each other. Documents shorter than a window lose nothing. Null ids are kept. Texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import batches_of, utf8, written

WINDOW = 35
PREFIX = 8
GROUP = 256  # occurrences of an anchor that one task grows a tree for
SALTS = 512  # tasks at most among which the occurrences of one span are dealt
STEP = 7  # words by which a subtree grows at a time
CHUNK = 1 << 18  # bytes of text hashed at a time, unless one document is longer

_BYTE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.uint64(0xD6E8FEB86659FD93)


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, as long as asked for."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size, self.base)]))
            self.down = np.cumprod(np.concatenate([one, np.full(size, self.inverse)]))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BYTE), _Powers(_WORD)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits; no two values meet."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sequence:
    """Words of several documents laid end to end; hashes of any run of words in constant time."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        words = [word for text in texts for word in text]
        self.sizes = np.array([len(text) for text in texts], np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        up, down = _byte_powers(len(letters) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * up[:-1])])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + lengths.astype(np.uint64))
        up, self.down = _word_powers(len(words) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])


def leftmost_least(values: np.ndarray, size: int) -> np.ndarray:
    """For every run of ``size`` values: the place of its least value, the leftmost of equals."""
    least, place, width = values, np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        left, right = least[: len(least) - step], least[step:]
        keep = left <= right
        place = np.where(keep, place[: len(place) - step], place[step:])
        least = np.where(keep, left, right)
        width += step
    return place


def occurrences(texts: list[list[bytes]], window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """Arrays (document, first window, number of windows, anchor's distance, anchor hash, span hash) of all windows."""
    sequence = Sequence(texts)
    n = len(sequence.sums) - 1
    if n < window:
        none = np.zeros(0, np.int64)
        return (none,) * 6
    firsts = np.cumsum(sequence.sizes) - sequence.sizes
    starts = np.arange(n - prefix + 1)
    grams = sequence.runs(starts, starts + prefix)
    anchor = leftmost_least(grams, window - prefix + 1)  # by window start
    document = np.repeat(np.arange(len(texts)), sequence.sizes)[: len(anchor)]
    start = np.arange(len(anchor))
    inside = start - firsts[document] + window <= sequence.sizes[document]
    start, anchor, document = start[inside], anchor[inside], document[inside]
    if not len(start):
        return (start,) * 6
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin, at, owner = start[first], anchor[first], document[first]
    span = mixed(sequence.runs(begin, begin + count + window - 1) + ((at - begin) * 4096 + count).astype(np.uint64))
    return owner, begin - firsts[owner], count, at - begin, grams[at].view(np.int64), span.view(np.int64)


def chunks(texts: Iterable[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Word lists of consecutive texts, about CHUNK bytes at a time, with the number of the first text."""
    held, size, first = [], 0, 0
    for number, text in enumerate(texts):
        held.append(text.split())
        size += len(text)
        if size >= CHUNK:
            yield first, held
            held, size, first = [], 0, number + 1
    if held:
        yield first, held


OCCURRENCE = "doc_id bigint, row_key bigint, place bigint, anchor bigint, span bigint"
_OCCURRENCE = pa.schema([(part.split()[0], pa.int64()) for part in OCCURRENCE.split(", ")])
SPOT = "doc_id bigint, row_key bigint, place bigint"
_SPOT = pa.schema([(part.split()[0], pa.int64()) for part in SPOT.split(", ")])
# A place packs the first window (from bit 12), the anchor's distance from it (6 bits) and the number of windows (6 bits).
START_BIT, SMALL = 12, 63


def place(start, count, anchor=0):
    return (start << START_BIT) + (anchor << 6) + count


def unpacked(packed: int) -> tuple[int, int, int]:
    """(first window, anchor's distance, number of windows) of a place."""
    return packed >> START_BIT, (packed >> 6) & SMALL, packed & SMALL


def _find_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(value.as_py() for value in batch.column(2)):
            owner, start, count, away, anchor, span = occurrences(texts)
            if len(owner):
                rows = pa.array(owner + first)
                columns = [batch.column(0).take(rows), batch.column(1).take(rows)]
                columns += [pa.array(c) for c in (place(start, count, away), anchor, span)]
                yield pa.RecordBatch.from_arrays(columns, schema=_OCCURRENCE)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the whole row's id and text, and the text as bytes."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        utf8("text").alias("text"),
    )


def repeated_occurrences(docs: DataFrame) -> DataFrame:
    """Occurrences whose anchor occurs more than once, and whether the anchor's spans differ (``branches``)."""
    found = _keyed(docs).mapInArrow(_find_occurrences, OCCURRENCE)
    anchors = (
        found.groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("low"), F.max("span").alias("high"))
        .filter("n > 1")
        .select("anchor", (F.col("low") != F.col("high")).alias("branches"))
    )
    return found.join(written(anchors, "suffix-anchors"), "anchor")  # stored, so that Spark can split hot anchors


def deep_leaves(suffixes: list[tuple[int, int]], words: list[list[bytes]], depth: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Suffixes (sequence, start) below a node of the suffix tree at ``depth`` words that has two leaves or more."""
    open_nodes = [(0, suffixes)]
    while open_nodes:
        at, leaves = open_nodes.pop()
        if at == depth:
            yield from leaves
            continue
        upto = min(at + STEP, depth)
        branches: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        for leaf in leaves:
            sequence, start = leaf
            branches.setdefault(tuple(words[sequence][start + at : start + upto]), []).append(leaf)
        open_nodes += [(upto, branch) for branch in branches.values() if len(branch) > 1]


def _runs(starts: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Runs (first, length) of consecutive numbers."""
    first = last = None
    for value in sorted(starts):
        if first is None or value != last + 1:
            if first is not None:
                yield first, last - first + 1
            first = value
        last = value
    if first is not None:
        yield first, last - first + 1


def _grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads classes (anchor, n, doc_id, row_key, place, words) sorted by anchor; yields places of repeated windows."""

    def tree(group: list[tuple]) -> Iterator[tuple]:
        words = [row[5].split() for row in group]
        suffixes = [(i, s) for i, w in enumerate(words) for s in range(len(w) - WINDOW + 1)]
        found: dict[int, list[int]] = {}
        for sequence, start in deep_leaves(suffixes, words):
            found.setdefault(sequence, []).append(start)
        for sequence, starts in found.items():
            _, n, doc_id, row_key, packed, _ = group[sequence]
            if n == 1:  # a class of several occurrences is repeated as a whole
                for first, length in _runs(starts):
                    yield doc_id, row_key, place((packed >> START_BIT) + first, length)

    def rows() -> Iterator[tuple]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    yield from tree(group)
                    group = []
                group.append(row)
        if group:
            yield from tree(group)

    return batches_of(rows(), _SPOT)


def _compress(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.array([packer.compress(value.as_py()) for value in batch], pa.binary())


def _unpacked(text: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(text).split()


def _span_words(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, places in batches:
        spans = []
        for text, held in zip(texts, places, strict=True):
            words = _unpacked(text.as_py())
            spans.append([_slice(words, packed) for packed in held.as_py()])
        yield pa.array(spans, pa.list_(pa.binary()))


def _slice(words: list[bytes], packed: int) -> bytes:
    start, _, count = unpacked(packed)
    return b" ".join(words[start : start + count + WINDOW - 1])


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _longer_prefixes(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Two extended prefixes of each span: the anchor with half a window's other words before it, and after it.

    Every window of the span holds one of them; null where no window of the span reaches as far.
    """
    half = (WINDOW - PREFIX + 1) // 2
    for spans, places in batches:
        out = []
        for span, packed in zip(spans, places, strict=True):
            words, (_, anchor, _) = span.as_py().split(), unpacked(packed.as_py())
            after = words[anchor : anchor + PREFIX + half]
            before = words[max(anchor - half, 0) : anchor + PREFIX]
            out.append([_digest(w) if len(w) == PREFIX + half else None for w in (before, after)])
        yield pa.array(out, pa.list_(pa.binary()))


def _window_hashes(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(window, hash) of the windows that hold the anchor with half a window before (side 0) or after it (side 1)."""
    half = (WINDOW - PREFIX + 1) // 2
    for spans, places, sides in batches:
        hashes = []
        for span, packed, side in zip(spans, places, sides, strict=True):
            words, (start, anchor, count) = span.as_py().split(), unpacked(packed.as_py())
            reach = range(max(anchor - half + 1, 0), count) if side.as_py() else range(min(anchor - half + 1, count))
            hashes.append([{"place": place(start + s, 1), "hash": _digest(words[s : s + WINDOW])} for s in reach])
        yield pa.array(hashes, pa.list_(pa.struct([("place", pa.int64()), ("hash", pa.binary())])))


def extended_groups(classes: DataFrame) -> DataFrame:
    """Repeated windows of classes in large groups (n, doc_id, row_key, place, words): prefixes are extended.

    First to the anchor and half a window on one side of it; only where that is shared, to the whole window. Leaves are
    counted by partial aggregation.
    """
    prefixes = F.arrow_udf("array<binary>")(_longer_prefixes)("words", "place")
    sided = classes.select("*", F.posexplode(prefixes).alias("side", "prefix")).filter("prefix is not null")
    shared = written(_repeated(sided, "side", "prefix"), "suffix-prefixes")
    windows = F.arrow_udf("array<struct<place:bigint,hash:binary>>")(_window_hashes)("words", "place", "side")
    grown = (
        sided.join(shared, ["side", "prefix"])
        .select("n", "doc_id", "row_key", F.explode(windows).alias("w"))
        .select("n", "doc_id", "row_key", "w.*")
    )
    whole = written(_repeated(grown, "hash"), "suffix-windows")
    return grown.filter("n = 1").join(whole, "hash").select("doc_id", "row_key", "place")


def _repeated(suffixes: DataFrame, *prefix: str) -> DataFrame:
    return suffixes.groupBy(*prefix).agg(F.sum("n").alias("leaves")).filter("leaves > 1").select(*prefix)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Key columns and the text, compressed for the shuffles that follow."""
    return _keyed(docs).withColumn("text", F.arrow_udf("binary")(_compress)("text"))


def repeated_places(docs: DataFrame) -> DataFrame:
    """Runs of repeated windows: doc_id, row_key, place. Rows may overlap."""
    # Dealt at random once and stored, so that one passage's places can be counted and joined in many tasks.
    salted = repeated_occurrences(docs).withColumn("salt", (F.rand() * SALTS).cast("int"))
    found = written(salted, "suffix-occurrences")
    dealt = (
        found.filter("branches")
        .groupBy("anchor", "span", "salt")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row_key", "place")).alias("first"))
    )
    dealt = written(dealt, "suffix-dealt")
    classes = dealt.groupBy("anchor", "span").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    classes = written(classes.select("anchor", "span", "n", "first.*"), "suffix-classes")
    groups = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).filter("least = 1")
    needed = classes.join(written(groups, "suffix-groups"), "anchor").select("anchor", "n", "size", "doc_id", "row_key", "place")
    by_text = needed.groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("anchor", "n", "size", "place")).alias("spots")
    )
    words = F.arrow_udf("array<binary>")(_span_words)
    texts = packed_documents(docs).dropDuplicates(["doc_id", "row_key"]).alias("t")
    fetched = (
        texts.join(by_text.alias("b"), _same_document("t", "b"))
        .select("b.doc_id", "b.row_key", "b.spots", words("t.text", F.col("b.spots.place")).alias("spans"))
        .select("doc_id", "row_key", F.explode(F.arrays_zip("spots", "spans")).alias("x"))
        .select("x.spots.*", "doc_id", "row_key", F.col("x.spans").alias("words"))
    )
    fetched = written(fetched, "suffix-spans")
    columns = ("anchor", "n", "doc_id", "row_key", "place", "words")
    grown = (
        fetched.filter(F.col("size") <= GROUP)
        .select(*columns)
        .repartition("anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_grow_trees, SPOT)
    )
    extended = extended_groups(fetched.filter(F.col("size") > GROUP))
    same = dealt.select("anchor", "span", "salt").join(classes.filter("n > 1"), ["anchor", "span"], "left_semi")
    same = written(same, "suffix-same")
    repeated = found.filter("branches").join(same, ["anchor", "span", "salt"], "left_semi")
    whole = repeated.unionByName(found.filter("not branches"))
    spots = whole.select("doc_id", "row_key", "place")
    return spots.unionByName(grown).unionByName(extended)


def _same_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.row_key") == F.col(f"{right}.row_key")
    )


def kept_words(words: list[bytes], places: Iterable[int] | None) -> list[bytes]:
    """The words outside all repeated windows."""
    kept, done = [], 0
    for packed in sorted(places or ()):
        start, _, count = unpacked(packed)
        kept += words[done:start]
        done = max(done, start + count + WINDOW - 1)
    return kept + words[done:]


_RESULT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _strip(whole: bool):
    def strip(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, places in batches:
            rows = []
            for text, held in zip(texts, places, strict=True):
                raw = zstandard.ZstdDecompressor().decompress(text.as_py())
                words = raw.split()
                kept = kept_words(words, held.as_py())
                left = raw if whole and len(kept) == len(words) else b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), left.decode()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _RESULT, strict=True)], fields=list(_RESULT)
            )

    return strip


def remove_repeats(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Struct columns ``row`` (of ``docs``, without the text) and ``deduped`` (n_words, n_removed, kept).

    ``kept`` holds the remaining words joined by one space; with ``whole``, a text that loses nothing stays as it is.
    """
    spots = repeated_places(docs).groupBy("doc_id", "row_key").agg(F.collect_set("place").alias("places"))
    spots = written(spots, "suffix-spots").alias("s")
    packed = (
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.xxhash64("doc_id", "text").alias("row_key"),
            F.arrow_udf("binary")(_compress)(utf8("text")).alias("packed"),
            F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"),
        )
    ).alias("t")
    stripped = F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")(_strip(whole))
    return packed.join(spots, _same_document("t", "s"), "left").select(
        "t.row", stripped("t.packed", "s.places").alias("deduped")
    )
