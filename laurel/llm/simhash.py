"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints: words of the text with A-Z folded, shingles of four words joined by a space (a shorter text is one
shingle), each hashed by XXH64 with seed 42; a bit is set if it is set in more than half of the hashes. Texts without
words have fingerprint zero.

Links: distinct fingerprints at ``MOST_BITS`` or fewer differing bits. The 64 bits are cut into m blocks; two linked
fingerprints agree in at least m - 4 of them, so every choice of m - 4 blocks deals the fingerprints into groups by
those blocks' bits. m follows from the number of fingerprints, so that unrelated ones rarely share a group.

A group is sorted by Gray rank and indexed from below: a node covers consecutive fingerprints and holds the bits in
which they all agree (pattern and mask). Pairs of nodes are followed from the top; a pair is pruned as soon as the
bits both nodes fix differ in more than four places. Fingerprints already connected are not compared again,
and a node whose members differ among themselves in at most four places is connected without looking at pairs. A
group yields links to one member per connected part, never all its pairs.

A group of more than ``SLICE`` fingerprints is dealt into slices, and every two slices meet in a task.

Components: alternating large-star and small-star steps over the links, each written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like others. Null ids take part; a component
is named by its smallest non-null id; where all ids are null, one row of each fingerprint counts as first. Equal rows
share a fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import LOWER, utf8, written

SHINGLE = 4
SEED = 42
MOST_BITS = 4
SLICE = 1024
FAN = 8
PAIRS = 1 << 16  # pairs of leaf nodes compared at a time
GROUP_GOAL = 256


def fingerprint(text: bytes) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - SHINGLE + 1, 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)),
        np.uint64,
        n,
    )
    counts = np.zeros(64, np.int64)
    for part in range(0, n, 1 << 16):
        counts += np.unpackbits(
            hashes[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
        ).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint(value.as_py()) for value in batch], pa.int64())


def with_fingerprint(docs: DataFrame, into: str = "fp", text: str = "text") -> DataFrame:
    prints = F.arrow_udf("bigint")(_fingerprints).asNondeterministic()  # costly: never copied into a filter
    return docs.withColumn(into, prints(utf8(text)))


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over distinct fingerprints in Gray order; finds connected parts under the distance limit."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        fixed = np.full(len(codes), ~np.uint64(0))
        self.levels = [(self.codes, fixed)]  # from single fingerprints up to one root
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            firsts = np.arange(0, len(pattern), FAN)
            lead = np.repeat(pattern[firsts], FAN)[: len(pattern)]
            agreed = np.bitwise_and.reduceat(mask & ~(pattern ^ lead), firsts)
            self.levels.append((pattern[firsts], agreed))

    def roots(self) -> np.ndarray:
        """For each fingerprint the place of one member of its connected part, the same for the whole part."""
        self.label = np.arange(len(self.codes))
        self._join_close_nodes()
        pending = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while pending:
            level, a, b = pending.pop()
            if len(a) > PAIRS:
                pending += [(level, a[PAIRS:], b[PAIRS:])]
                a, b = a[:PAIRS], b[:PAIRS]
            pattern, mask = self.levels[level]
            apart = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])
            near = apart <= MOST_BITS
            a, b = a[near], b[near]
            if level == 0:
                self._join(a, b)
            elif len(a):
                pending.append((level - 1, *self._children(level - 1, a, b)))
        return self.label

    def _children(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(FAN)
        x = (a[:, None, None] * FAN + step[:, None] + 0 * step[None, :]).reshape(-1)
        y = (b[:, None, None] * FAN + step[None, :] + 0 * step[:, None]).reshape(-1)
        size = len(self.levels[level][0])
        fits = (x < size) & (y < size) & (x <= y)
        if level == 0:
            fits &= x != y
            x, y = x[fits], y[fits]
            apart = self.label[x] != self.label[y]
            return x[apart], y[apart]
        return x[fits], y[fits]

    def _join_close_nodes(self) -> None:
        """Connects nodes whose members differ among themselves in at most MOST_BITS places."""
        width = 1
        for _, mask in self.levels[1:]:
            width *= FAN
            close = np.bitwise_count(~mask) <= MOST_BITS
            first = np.arange(len(mask)) * width
            node = np.arange(len(self.codes)) // width
            self.label = np.where(close[node], first[node], self.label)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            x, y = label[a], label[b]
            open_pairs = x != y
            a, b, x, y = a[open_pairs], b[open_pairs], x[open_pairs], y[open_pairs]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:  # follow labels to their roots
                higher = label[label]
                if np.array_equal(higher, label):
                    break
                label[:] = higher


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows (group columns ..., fp) sorted by group; yields links from members to one member of their part."""

    def links(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        index = GrayIndex(np.concatenate(codes).view(np.uint64))
        roots = index.roots()
        own = np.flatnonzero(roots != np.arange(len(roots)))
        return index.codes[own].view(np.int64), index.codes[roots[own]].view(np.int64)

    def groups() -> Iterator[list[np.ndarray]]:
        last, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, codes = (np.asarray(c) for c in batch.columns)
            change = np.zeros(len(codes), bool)
            for key in keys:
                change[1:] |= key[1:] != key[:-1]
            cuts = np.flatnonzero(change)
            for start, end in zip([0, *cuts], [*cuts, len(codes)], strict=True):
                group = tuple(key[start] for key in keys)
                if group != last and held:
                    yield held
                    held = []
                last = group
                held.append(codes[start:end])
        if held:
            yield held

    found, size = [], 0
    for group in groups():
        if sum(map(len, group)) > 1:
            found.append(links(group))
            size += len(found[-1][0])
        if size >= 1 << 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_LINK)
            found, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], schema=_LINK)


def block_masks(n: int) -> list[int]:
    """Bit masks of all choices of blocks that two linked fingerprints can share, for ``n`` fingerprints."""
    m = MOST_BITS + 1
    while 64 * (m - MOST_BITS) / m < math.log2(max(n, 2) / GROUP_GOAL) and m < 12:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, m - MOST_BITS)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within MOST_BITS, each part by a few."""
    masks = block_masks(distinct.count())
    keys = F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(mask))) for mask in masks))
    dealt = distinct.select("fp", F.posexplode(keys).alias("choice", "bits"))
    large = written(dealt.groupBy("choice", "bits").count().filter(F.col("count") > SLICE), "simhash-large")
    slices = F.ceil(F.col("count") / SLICE)
    spread = dealt.join(large, ["choice", "bits"], "left").select(
        "choice", "bits", "fp", F.coalesce(slices, F.lit(1)).cast("int").alias("slices")
    )
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("slices")).cast("int")
    met = spread.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    tasks = met.select(
        "choice", "bits", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp"
    )
    group = ("choice", "bits", "x", "y")
    return tasks.repartition(*group).sortWithinPartitions(*group).mapInArrow(_link_groups, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component."""
    oriented = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, state = written(oriented, "links"), None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links-small")
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, component_id) of every distinct fingerprint in ``prints`` (columns ``key`` and fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min(key).alias("first_id")), "fingerprints")
    found = components(links(distinct.select("fp")))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, fingerprint (hex) and component_id of every row."""
    prints = written(with_fingerprint(docs.select(key, "text"), "fp").select(key, "fp"), "simhash")
    return prints.join(near_duplicates(prints, key), "fp").select(key, as_hex("fp").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One row of every component (that with the smallest id; of equal ids, one), with the columns of ``docs``."""
    marked = with_fingerprint(docs, "__fp")
    prints = written(marked.select("doc_id", "__fp").withColumnRenamed("__fp", "fp"), "simhash")
    named = near_duplicates(prints)
    first = (
        prints.join(named, "fp")
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("kept"))
        .select(F.col("kept.doc_id").alias("__id"), F.col("kept.fp").alias("__print"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__print"))
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", "__fp"]).select(*docs.columns)
