"""Fill-in-middle transformation with content-defined chunks.

A text is cut into tokens (a word with the white space before it; white space at the end is a token), and into prefix,
middle and suffix at two seeded token counts. Finding the places means counting tokens, and texts share
passages, so the counting is remembered by chunk:

* A rolling (gear) hash over ``ROLL`` bytes ends a chunk where its low bits are zero. That depends on the bytes around the
  place alone, so a passage shared by several texts falls into the same chunks wherever it stands. Chunks have
  ``LEAST`` to ``MOST`` bytes.
* A task remembers each chunk's boundary summary: word starts, whether its first and last bytes belong to a word, and its
  code points. A remembered chunk counts only if its bytes are equal, so a hash collision changes nothing. The cache
  holds ``CACHE_BYTES`` of chunks and forgets the oldest; it saves work and never decides a result.
* Summaries combine from left to right: a word that runs over a chunk's end is counted once. The running sums tell in
  which chunk a cut lies, and only that chunk is searched for its place.

No row leaves its partition: there is no shuffle.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` the text itself. Texts that
hold a mark stay plain, so ``restored`` finds each mark of an output at its first occurrence: a mark cannot begin inside a
text and end in a mark, as marks begin with < and hold no other.

Defined cases: a null text is empty, an empty text is plain with 0 tokens. A null id is written as nothing behind the
seed. Texts of any length take memory for themselves and one block of hashes. Equal rows give equal results. Other columns
are kept; where one has a result's name, the result replaces it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from laurel.llm.common import utf8

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
MARKS = (b"<P>", b"<S>", b"<M>")

ROLL = 32
LEAST, MEAN, MOST = 256, 1024, 8192  # bytes of a chunk; MEAN is a power of two
BLOCK = 1 << 20  # bytes that are hashed at a time
CACHE_BYTES = 32 << 20

_GEAR = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
_CONTINUES = bytes(range(0x80, 0xC0))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SPACES = frozenset(b" \t\n\v\f\r")


class Summary(NamedTuple):
    starts: int  # words, if the byte before the chunk is white space
    first: bool  # its first byte belongs to a word
    last: bool
    whole: bool  # it is part of one word
    chars: int


class Cut(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def ends_of_rolls(data: bytes) -> np.ndarray:
    """Places after which the gear hash of the last ROLL bytes ends a chunk."""
    found = []
    for start in range(0, len(data), BLOCK):
        lead = min(start, ROLL - 1)
        rolled = _GEAR[np.frombuffer(data, np.uint8, min(BLOCK, len(data) - start) + lead, start - lead)]
        width = 1
        while width < ROLL:  # each step doubles the bytes that a hash covers
            following = rolled.copy()
            following[width:] += rolled[:-width] << np.uint32(width)
            rolled, width = following, 2 * width
        hits = np.flatnonzero((rolled[lead:] >> np.uint32(16)) & np.uint32(MEAN - 1) == 0)
        found.append(hits + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(length: int, rolls: list[int]) -> list[int]:
    """The ends of a text's chunks, from the places ``rolls`` that its content suggests."""
    ends, at = [], 0
    for end in (*rolls, length):
        if end - at < LEAST and end < length:
            continue
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end > at:
            ends.append(end)
            at = end
    return ends


def summary_of(chunk: bytes) -> Summary:
    words = len(chunk.split())
    first, last = chunk[0] not in _SPACES, chunk[-1] not in _SPACES
    whole = words == 1 and first and last and _WORD.match(chunk).end() == len(chunk)
    return Summary(words, first, last, whole, len(chunk.translate(None, _CONTINUES)))


class Memo:
    """Summaries of chunks by hash, valid only for equal bytes; a bounded number of bytes is kept."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.size = most, 0
        self.held: dict[int, tuple[bytes, Summary]] = {}

    def summary(self, chunk: bytes) -> Summary:
        key = hash(chunk)
        known = self.held.get(key)
        if known is not None and known[0] == chunk:
            return known[1]
        found = summary_of(chunk)
        if known is None:
            self.held[key] = (chunk, found)
            self.size += len(chunk)
            while self.size > self.most:
                self.size -= len(self.held.pop(next(iter(self.held)))[0])
        return found


class Chunks:
    """A text's chunks with running sums of words and code points."""

    def __init__(self, data: bytes, memo: Memo):
        self.data, self.words, self.chars = data, 0, 0
        self.ends = chunk_ends(len(data), ends_of_rolls(data).tolist())
        self.before: list[tuple[int, int, bool]] = []  # words and code points before a chunk; a word runs into it
        self.parts: list[Summary] = []
        at, open_word = 0, False
        for end in self.ends:
            part = memo.summary(data[at:end])
            joined = open_word and part.first
            self.before.append((self.words, self.chars, joined))
            self.parts.append(part)
            self.words += part.starts - joined
            self.chars += part.chars
            at, open_word = end, part.last
        self.tokens = self.words + (len(data) > 0 and not open_word)

    def start(self, chunk: int) -> int:
        return self.ends[chunk - 1] if chunk else 0

    def cut(self, tokens: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``tokens`` tokens."""
        if tokens == 0:
            return 0, 0
        if tokens == self.tokens:
            return len(self.data), self.chars
        low, high = 0, len(self.ends) - 1  # the last chunk with fewer words before it holds the word's start
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.before[middle][0] < tokens else (low, middle - 1)
        words, _, joined = self.before[low]
        content = self.data[self.start(low) : self.ends[low]]
        end = next(islice(_WORD.finditer(content), tokens - words - 1 + joined, None)).end() + self.start(low)
        chunk = low
        while end == self.ends[chunk] and chunk + 1 < len(self.ends) and self.parts[chunk + 1].first:
            chunk += 1
            part = self.parts[chunk]
            end = self.ends[chunk] if part.whole else _WORD.match(self.data, end, self.ends[chunk]).end()
        chars = self.before[chunk][1] + len(self.data[self.start(chunk) : end].translate(None, _CONTINUES))
        return end, chars


def transform(data: bytes, key: str, memo: Memo) -> Cut:
    """The transformed text; ``key`` is the hex digest that seeds it."""
    draws = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    text = Chunks(data, memo)
    n = text.tokens
    if not data or draws[2] % 100 >= FIM_PERCENT or any(mark in data for mark in MARKS):
        return Cut(n, "plain", None, None, data)
    (a, a_chars), (b, b_chars) = (text.cut(t) for t in sorted((draws[0] % (n + 1), draws[1] % (n + 1))))
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    p, s, m = MARKS
    spm = draws[3] % 100 < SPM_PERCENT
    parts = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
    return Cut(n, "spm" if spm else "psm", a_chars, b_chars - a_chars, b"".join(parts))


_FIELDS = pa.struct([
    ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("output", pa.string()),
])
_CUT = from_arrow_type(_FIELDS)


@F.arrow_udf(_CUT)
def _transformed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    memo = Memo()
    for texts, keys in batches:
        cuts = [transform(t.as_py(), k.as_py(), memo) for t, k in zip(texts, keys, strict=True)]
        columns = list(zip(*cuts, strict=True)) if cuts else [[] for _ in _FIELDS]
        arrays = [pa.array(c, f.type) for c, f in zip(columns[:-1], _FIELDS, strict=False)]
        outputs = pa.array(columns[-1], pa.binary()).cast(pa.string())
        yield pa.StructArray.from_arrays([*arrays, outputs], fields=list(_FIELDS))


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    cut = docs.withColumn("__cut", _transformed.asNondeterministic()(utf8("text"), key))
    names = [f.name for f in _FIELDS]
    return cut.select(*(c for c in docs.columns if c not in names), *(F.col(f"__cut.{n}").alias(n) for n in names))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def after(mark: str) -> Column:
        return F.substring_index(output, mark, -1)

    p, s, m = (mark.decode() for mark in MARKS)
    psm = F.concat(F.substring_index(after(p), s, 1), after(m), F.substring_index(after(s), m, 1))
    spm = F.concat(F.substring_index(after(p), m, 1), after(m), F.substring_index(after(s), p, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
