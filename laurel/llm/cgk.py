"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distance.

A document is contaminated by an item if some stretch of its words is within ``tolerance`` times the item's
length (whole edits, words as symbols) of the item. Words are lower-case runs of digits, a-z and non-ASCII
characters.

Method. The CGK walk reads a window from its start and copies the current word at every step; a random bit of (step,
word) tells whether it moves on. Two windows at edit distance k give walks that differ in about k*k places, so edit
distance becomes Hamming distance. Each repetition has its own walk and samples ``SAMPLED`` places of it; item and
window are candidates if these agree. The number of repetitions is the least that finds ``RECALL`` of seeded trial
mutations of the items at the full tolerance, measured before the search. Windows are as long as the items (item
lengths are put into classes); candidates are verified by exact edit distance against the item.

Classes of lengths (of long items) for which ``MOST_REPETITIONS`` do not reach ``RECALL`` have no walks: every
stretch that passes the count of shared sequences below goes straight to the exact edit distance, so none is lost.
``Items.recall`` holds the recall of each class: measured by trials, or 1 without walks.

Verbatim copies need no walk: the hash of a whole item is looked up at every place that begins like an item, and
the words are compared. Items without allowed edits are searched in this way only.

Before the walk, windows that cannot match are passed over without loss: an item of n words and a stretch within d
edits share at least n - 2 - 3d three-word sequences, so windows with fewer three-word sequences of any item are out
(the least of these bounds over all items of a class of lengths; the trials go through this count too).

The items are a query set: they are read in blocks of ``BLOCK_ITEMS``, each broadcast and held against all documents.

Defined cases: null and empty texts are clean. Items that are null or have fewer than ``LEAST_WORDS`` words are no
evidence. Repeated items each give their rows. Null ids are kept. Texts are searched whole, with no cap on hits. Empty
tables give empty results.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import LOWER_ALNUM, utf8

log = logging.getLogger(__name__)

TOLERANCE = 0.2
RECALL = 0.98
SAMPLED = 3
LEAST_WORDS = 5
EDITS_FROM = 8  # shorter items must match word for word
BLOCK_ITEMS = 20_000
SEED = 20
TRIALS = 200  # trial mutations for each class of lengths
MOST_REPETITIONS = 256  # a class of lengths that needs more is searched without walks
GRAM = 3
FILTER_BITS = 24
HASH_BASE = 0x9E3779B97F4A7C15


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


def edits_allowed(n: int) -> int:
    return int(TOLERANCE * n) if n >= EDITS_FROM else 0


def shared_grams(n: int) -> int:
    """Three-word sequences of an item of ``n`` words that the allowed edits cannot break."""
    return max(n - (GRAM - 1) - GRAM * edits_allowed(n), 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def coins(n_symbols: int, repetition: int, part: int) -> np.ndarray:
    """For every symbol 64 random bits: whether the walk moves on at steps 64 * part to 64 * part + 63."""
    return _mixed(np.arange(n_symbols, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((repetition << 8) + part + 1))


def walks(symbols: np.ndarray, starts: np.ndarray, n_symbols: int, repetition: int, places: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Follows the walk from each start; yields the walkers' numbers and the symbols at each of ``places`` (ascending).

    The caller may send back which of these walkers go on.
    """
    at, walker = starts.copy(), np.arange(len(starts))
    table, part = None, -1
    for step in range(places[-1] + 1):
        symbol = symbols[at]
        if step in places:
            going = yield walker, symbol
            if going is not None:
                at, walker, symbol = at[going], walker[going], symbol[going]
                if not len(at):
                    return
        if step >> 6 != part:
            part = step >> 6
            table = coins(n_symbols, repetition, part)
        at += ((table[symbol] >> np.uint64(step & 63)) & np.uint64(1)).astype(np.int64)


def sampled_places(size: int, repetition: int) -> list[int]:
    """The steps of the walk that a repetition samples, for items of at least ``size`` words.

    A step moves by one word at most, so steps below ``size`` lie inside every item.
    """
    draw = np.random.default_rng([SEED, size, repetition])
    return sorted(draw.choice(size, SAMPLED, replace=False).tolist())


class Items:
    """One block of benchmark items with their LSH tables. Built on the driver, sent to the executors."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = []
        for item_id, text in rows:
            words = words_of((text or "").encode())
            if len(words) >= LEAST_WORDS:
                codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
                self.items.append((item_id, np.array(codes, np.int64)))
        self.items.sort(key=lambda item: len(item[1]))
        self.classes: dict[int, list[int]] = {}  # least length -> the items up to an eighth longer
        least = 0
        for number, (_, codes) in enumerate(self.items):
            if not edits_allowed(len(codes)):
                continue  # the lookup of whole items finds all there is
            if not least or len(codes) > least * 9 // 8:
                least = len(codes)
            self.classes.setdefault(least, []).append(number)
        if (len(self.vocabulary) + 1) ** SAMPLED >= 1 << 63:
            raise ValueError("too many different words in a block of items")
        self.longest = len(self.items[-1][1]) if self.items else 0
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        for _, codes in self.items:
            self.filter[gram_cells(codes)] = True
        self.verbatim: dict[int, dict[int, list[int]]] = {}  # length -> hash of the whole item -> items
        beginnings, first = [], np.zeros(1, np.int64)
        for number, (_, codes) in enumerate(self.items):
            whole = Sequences(codes)
            beginnings.append(whole.hashes(first, LEAST_WORDS)[0])
            self.verbatim.setdefault(len(codes), {}).setdefault(int(whole.hashes(first, len(codes))[0]), []).append(number)
        self.beginnings = np.unique(np.array(beginnings, np.uint64))
        self.tables, self.recall, self.exact = {}, {}, {}
        for size, members in self.classes.items():
            tables, recall = self._tables(size, members)
            if recall >= RECALL:
                self.tables[size], self.recall[size] = tables, recall
            else:
                cells = [gram_cells(self.items[n][1]) for n in members]
                self.exact[size] = np.concatenate(cells), np.cumsum([0, *map(len, cells[:-1])])
                self.recall[size] = 1.0
            log.info("items from %d words: recall %.3f by %s", size, self.recall[size], "walks" if size in self.tables else "alignment")

    def _walk(self, size: int, windows: list[np.ndarray], repetition: int) -> np.ndarray:
        """The sampled symbols of each window, one row a window."""
        width = 2 * size + self.longest
        padded = np.zeros((len(windows), width), np.int64)
        for row, window in zip(padded, windows, strict=True):
            row[: len(window)] = window
        starts = np.arange(len(windows)) * width
        seen = walks(padded.reshape(-1), starts, len(self.vocabulary) + 1, repetition, sampled_places(size, repetition))
        return np.stack([symbols for _, symbols in seen], 1)

    def _keys(self, seen: np.ndarray) -> list[np.ndarray]:
        """The sampled symbols as one number each, for every number of leading samples."""
        base, keys = len(self.vocabulary) + 1, [np.zeros(len(seen), np.int64)]
        for column in seen.T:
            keys.append(keys[-1] * base + column)
        return keys[1:]

    def least_shared(self, members: list[int]) -> int:
        """Three-word sequences that a stretch within the allowed edits shares with any of the items, at the least.

        The edits allowed jump with the length, so the shortest item need not be the one that shares the fewest.
        """
        return min(shared_grams(len(self.items[n][1])) for n in members)

    def _passes(self, window: np.ndarray, least: int) -> bool:
        """Whether the count of known three-word sequences lets the window through."""
        inside = (window[:-2] > 0) & (window[1:-1] > 0) & (window[2:] > 0)
        return int((self.filter[gram_cells(window)] & inside).sum()) >= least

    def _tables(self, size: int, members: list[int]) -> tuple[list[tuple[list[np.ndarray], dict[int, list[int]]]], float]:
        """For each repetition the known leading samples (sorted) and the items by all samples; the measured recall.

        As many repetitions as find RECALL of the trial mutations, or MOST_REPETITIONS that do not.
        """
        tables: list[tuple[list[np.ndarray], dict[int, list[int]]]] = []
        draw = np.random.default_rng([SEED, size])
        chosen = [members[i % len(members)] for i in range(max(TRIALS, len(members)))]
        changed = [mutated(self.items[n][1], edits_allowed(len(self.items[n][1])), draw) for n in chosen]
        least = self.least_shared(members)
        passed = np.array([self._passes(window, least) for window in changed])
        met = np.zeros(len(changed), bool)
        while not tables or (met.mean() < RECALL and len(tables) < MOST_REPETITIONS):
            own = self._walk(size, [self.items[n][1] for n in members], len(tables))
            trial = self._walk(size, changed, len(tables))
            met |= (own[np.arange(len(changed)) % len(members)] == trial).all(1) & passed
            keys = self._keys(own)
            by_key: dict[int, list[int]] = {}
            for number, key in zip(members, keys[-1].tolist(), strict=True):
                by_key.setdefault(key, []).append(number)
            tables.append(([np.unique(k) for k in keys], by_key))
        return tables, float(met.mean())

    def copies(self, codes: np.ndarray) -> set[tuple[int, int]]:
        """(item, start) of all places of ``codes`` whose next words have the hash of a whole item."""
        found: set[tuple[int, int]] = set()
        sequences = Sequences(codes)
        opening = sequences.hashes(np.arange(len(codes) - LEAST_WORDS + 1), LEAST_WORDS)
        at = np.minimum(np.searchsorted(self.beginnings, opening), len(self.beginnings) - 1)
        starts = np.flatnonzero(self.beginnings[at] == opening)
        for length, by_hash in self.verbatim.items():  # ascending
            starts = starts[starts + length <= len(codes)]
            for start, value in zip(starts.tolist(), sequences.hashes(starts, length).tolist(), strict=True):
                found.update((number, start) for number in by_hash.get(value, ()))
        return found

    def starts(self, size: int, hits: np.ndarray) -> np.ndarray:
        """Starts of all windows with enough three-word sequences for some item of the class."""
        n, members = len(hits) - 1, self.classes[size]
        longest = len(self.items[members[-1]][1])
        ends = np.minimum(np.arange(n) + longest + edits_allowed(longest), n)
        return np.flatnonzero(hits[ends] - hits[:n] >= self.least_shared(members))

    def regions(self, codes: np.ndarray, hits: np.ndarray, offset: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, text, from, to) of all stretches in which an item whose class has no tables can stand.

        Windows that overlap make one stretch, which ends with its text; an item stands in it only if enough of the
        item's own three-word sequences occur there.
        """
        for size, (cells, firsts) in self.exact.items():
            starts = self.starts(size, hits)
            if not len(starts):
                continue
            members = self.classes[size]
            longest = len(self.items[members[-1]][1])
            needed = np.array([shared_grams(len(self.items[n][1])) for n in members])
            at = np.searchsorted(offset, starts, "right") - 1
            breaks = np.flatnonzero((np.diff(starts) > longest + edits_allowed(longest)) | (np.diff(at) > 0)) + 1
            for run in np.split(np.arange(len(starts)), breaks):
                text = int(at[run[0]])
                begin, end = int(starts[run[0]]), min(int(starts[run[-1]]) + longest + edits_allowed(longest), int(ends[text]))
                shared = np.add.reduceat(np.isin(cells, gram_cells(codes[begin:end])), firsts, dtype=np.int64)
                for number in np.flatnonzero(shared >= needed).tolist():
                    yield members[number], text, begin - int(offset[text]), end - int(offset[text])

    def candidates(self, codes: np.ndarray, hits: np.ndarray) -> set[tuple[int, int]]:
        """(item, start) of all windows of ``codes`` that agree with an item in all samples of some repetition."""
        found, base = set(), len(self.vocabulary) + 1
        for size in self.tables:
            starts = self.starts(size, hits)
            if not len(starts):
                continue
            for repetition, (leading, by_key) in enumerate(self.tables[size]):
                walk = walks(codes, starts, base, repetition, sampled_places(size, repetition))
                going, key = None, np.zeros(len(starts), np.int64)
                for depth, known in enumerate(leading):
                    walker, symbol = walk.send(going) if depth else next(walk)
                    key = (key if going is None else key[going]) * base + symbol
                    going = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    if not going.any():
                        break
                for place, value in zip(walker[going].tolist(), key[going].tolist(), strict=True):
                    found.update((number, int(starts[place])) for number in by_key[value])
        return found

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (item number, first word, edits) of the best place of every item found in it."""
        found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if not self.items:
            return [[] for _ in texts]
        coded, offsets, total = [], [], 0
        for text in texts:
            words = words_of(text)
            coded.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)))
            coded.append(np.zeros(GRAM, np.int64))  # no sequence reaches from text to text
            offsets.append(total)
            total += len(words) + GRAM
        codes = np.concatenate([*coded, np.zeros(3 * self.longest, np.int64)])
        known = self.filter[gram_cells(codes)] & (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0)
        hits = np.concatenate([[0], np.cumsum(known[:total])])
        offset = np.array(offsets)
        verified: dict[tuple[int, bytes], tuple[int, int]] = {}
        close = []
        for number, start in sorted(self.copies(codes) | self.candidates(codes, hits)):
            at = int(np.searchsorted(offset, start, "right")) - 1
            local, item = start - offsets[at], self.items[number][1]
            if np.array_equal(coded[2 * at][local : local + len(item)], item):
                found[at].setdefault(number, (local, 0))
            else:
                close.append((number, at, local))
        stretches = []
        for number, at, local in close:
            allowed = edits_allowed(len(self.items[number][1]))
            stretches.append((number, at, max(local - allowed, 0), local + len(self.items[number][1]) + 2 * allowed))
        lengths = np.array([len(c) for c in coded[::2]])
        stretches += self.regions(codes, hits, offset, offset + lengths)
        for number, at, begin, end in stretches:
            item, best = self.items[number][1], found[at].get(number)
            allowed, stretch = edits_allowed(len(item)), coded[2 * at][begin:end]
            if (best and best[1] == 0) or np.isin(item, stretch).sum() < len(item) - allowed:
                continue
            key = number, stretch.tobytes()
            if key not in verified:
                verified[key] = best_place(item, stretch)
            edits, first = verified[key]
            if edits <= allowed and (best is None or (edits, begin + first) < (best[1], best[0])):
                found[at][number] = (begin + first, edits)
        return [[(number, *place) for number, place in sorted(held.items())] for held in found]


def gram_cells(codes: np.ndarray) -> np.ndarray:
    """Cells of the three-word sequences in the filter."""
    if len(codes) < GRAM:
        return np.zeros(0, np.int64)
    codes = codes.astype(np.uint64)
    grams = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1]) * np.uint64(0x85EBCA77) + codes[2:]
    return (_mixed(grams) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class Sequences:
    """Hashes of word sequences of any length, the same wherever they stand: differences of sums modulo 2^64."""

    def __init__(self, codes: np.ndarray) -> None:
        terms = _mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(HASH_BASE, len(codes))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = powers(pow(HASH_BASE, -1, 1 << 64), len(codes))

    def hashes(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the ``length`` words from each start."""
        return (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def mutated(codes: np.ndarray, edits: int, draw: np.random.Generator) -> np.ndarray:
    """A copy with ``edits`` random insertions, deletions and replacements by words that are no item's."""
    out = codes.tolist()
    for _ in range(edits):
        at, kind = int(draw.integers(len(out))), int(draw.integers(3))
        out[at : at + (kind != 0)] = [] if kind == 1 else [0]
    return np.array(out, np.int64)


def best_place(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least edits between ``item`` and any part of ``stretch``, and where that part begins."""
    n = len(stretch)
    places, wide = np.arange(n + 1), np.int64(n + 2)
    costs, begins = np.zeros(n + 1, np.int64), places.copy()
    for i, word in enumerate(item.tolist(), 1):
        above = costs + 1
        beside = costs[:-1] + (stretch != word)
        diagonal = beside <= above[1:]
        new_costs = np.concatenate([[i], np.where(diagonal, beside, above[1:])])
        new_begins = np.concatenate([[0], np.where(diagonal, begins[:-1], begins[1:])])
        # words of the stretch that the item lacks: the last place from which going on costs least
        least = np.minimum.accumulate((new_costs - places) * wide - places)
        source = -least % wide
        costs, begins = (least + source) // wide + places, new_begins[source]
    best = int(np.argmin(costs))
    return int(costs[best]), int(begins[best])


HIT = "array<struct<item_id:bigint,first_word:bigint,edits:bigint>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("edits", pa.int64())]))


def _searcher(block: Broadcast):
    @F.arrow_udf(HIT)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = block.value
        for batch in batches:
            found = items.search([value.as_py() for value in batch])
            named = [[(items.items[n][0], first, edits) for n, first, edits in row] for row in found]
            yield pa.array([[dict(zip(("item_id", "first_word", "edits"), h, strict=True)) for h in row] for row in named], _HIT)

    return search


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded length, streamed through the driver one block at a time."""
    held: list[tuple[int, str]] = []
    for row in benchmark.select("item_id", "text").toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> Column:
    """An array column of (item_id, first_word, edits) for each row of ``docs``."""
    context = docs.sparkSession.sparkContext
    blocks = [context.broadcast(Items(block)) for block in item_blocks(benchmark)]
    if not blocks:
        return F.lit(None).cast(HIT)
    return F.concat(*(_searcher(block)(utf8(text)) for block in blocks))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, edits: a row for every item found in a document."""
    found = docs.select("doc_id", F.explode(hits(docs, benchmark)).alias("hit"))
    return found.select("doc_id", "hit.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns of ``docs``."""
    return docs.withColumn("__hits", hits(docs, benchmark)).filter(F.coalesce(F.size("__hits"), F.lit(0)) <= 0).select(*docs.columns)

