"""Chat formatting on the level of tokens.

Method: each turn's role and text are encoded by themselves and spliced between reserved ids that no text can
produce: ``OPEN role SEPARATOR text CLOSE``. The loss mask of a conversation is the prefix sum of +1 where an
assistant text begins and -1 where it ends. Control strings inside roles and texts are escaped by a backslash (which
is escaped too), so the written-out form can be read back as well.

Turns are encoded where they lie; then a conversation's turns meet in one task, sorted, and stream through it one at
a time: digests and counts are carried on, no conversation is held whole.

Defined cases: null texts and roles count as empty. Turns sort by number (null first), then role and text, so equal
turns stay, side by side. A null conversation id is a conversation of its own. An empty table gives an empty result.
Texts are never cut. Only the columns conv_id, turn, role and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import batches_of

# The template's control strings; their ids follow the vocabulary.
CONTROL = ("### ", ": ", "</turn>\n")
OPEN, SEPARATOR, CLOSE = range(3)
# The pattern by which the byte-level vocabulary cuts texts before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ESCAPED = re.compile(r"\\|###|</turn>")
_ESCAPE = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


class ChatTokens:
    """Encodes and decodes turns with a byte-level vocabulary and reserved ids behind it."""

    def __init__(self, ranks_file: bytes) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self.first = max(ranks.values()) + 1  # id of the first control string
        self.encoding = tiktoken.Encoding("laurel", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(escape(text))

    def decode(self, ids: np.ndarray) -> str:
        """The (still escaped) text of ids that hold no control string."""
        return self.encoding.decode_bytes(ids.tolist()).decode()

    def turns(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns end to end, the mask's steps beside them and the turns' offsets.

        A step is +1 where an assistant's text begins and -1 where it ends, else 0.
        """
        ids: list[int] = []
        offsets, begins, ends = [0], [], []
        heads: dict[str, list[int]] = {}  # few roles: encoded once a batch
        for role, text in zip(roles, texts, strict=True):
            if role not in heads:
                heads[role] = [self.first + OPEN, *self.encode(role), self.first + SEPARATOR]
            ids += heads[role]
            begin = len(ids)
            ids += self.encode(text)
            if role == "assistant":
                begins.append(begin)
                ends.append(len(ids))
            ids.append(self.first + CLOSE)
            offsets.append(len(ids))
        steps = np.zeros(len(ids), np.int8)
        np.add.at(steps, np.array(begins, np.int64), 1)
        np.add.at(steps, np.array(ends, np.int64), -1)
        return np.array(ids, np.int32), steps, np.array(offsets, np.int32)

    def written(self, ids: np.ndarray) -> tuple[str, list[str]]:
        """The template's text form of a token sequence, and the segments between its control strings."""
        controls = np.flatnonzero(ids >= self.first)
        segments, out, start = [], [], 0
        for end in controls.tolist():
            segments.append(self.decode(ids[start:end]))
            out += [segments[-1], CONTROL[ids[end] - self.first]]
            start = end + 1
        return "".join(out), segments


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_shared: dict[str, ChatTokens] = {}


def _tokens(ranks: Broadcast) -> ChatTokens:
    name, content = ranks.value
    if name not in _shared:
        _shared[name] = ChatTokens(content)
    return _shared[name]


TOKENS_SCHEMA = "conv_id bigint, turn_no bigint, ids array<int>, mask array<tinyint>"
_TOKENS = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.int8()))]
)
READ_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
    "formatted_chars bigint, n_tokens bigint"
)
_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())]
)


def broadcast_vocabulary(docs: DataFrame, path: str) -> Broadcast:
    """The ranks file (one vocabulary) for all executors."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast((path, file.read()))


def format_turns(conversations: DataFrame, ranks: Broadcast) -> DataFrame:
    """Tokens and loss mask: one row per turn, a conversation's rows together in turn order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks)
        for batch in batches:
            ids, steps, offsets = tokens.turns(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(offsets, ids), _lists(offsets, steps)],
                names=["conv_id", "turn", "role", "text", "ids", "steps"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, level = object(), 0, 0
        for batch in batches:
            numbers = []
            for conv in batch.column(0).to_pylist():
                last, number = conv, number + 1 if conv == last else 0
                numbers.append(number)
            # The prefix sum goes on from turn to turn and batch to batch; every turn closes what it opens.
            ids, steps = batch.column(1), batch.column(2).flatten().to_numpy()
            mask = level + np.cumsum(steps, dtype=np.int64)
            level = int(mask[-1]) if len(mask) else level
            offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int64()), ids, _lists(offsets, mask.astype(np.int8))],
                schema=_TOKENS,
            )

    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    encoded = rows.mapInArrow(
        encode, "conv_id bigint, turn bigint, role string, text string, ids array<int>, steps array<tinyint>"
    )
    together = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "ids", "steps").mapInArrow(assemble, TOKENS_SCHEMA)


def read_back(formatted: DataFrame, ranks: Broadcast) -> DataFrame:
    """One row per conversation, read from the tokens and masks alone. Takes rows as ``format_turns`` gives them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks)

        def summary(state) -> tuple:
            conv, turns, digest, chars, loss, written, size = state
            return conv, turns, digest.hexdigest(), chars, loss.hexdigest(), written, size

        def rows():
            state = None
            for batch in batches:
                convs, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for conv, number, ids, mask in zip(convs, numbers, batch.column(2), batch.column(3), strict=True):
                    if number == 0:
                        if state:
                            yield summary(state)
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                    template, (_, role, text) = tokens.written(ids)
                    state[1] += 1
                    state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    if mask.any():
                        learned = unescape(tokens.decode(ids[mask == 1]))
                        state[3] += len(learned)
                        state[4].update(learned.encode())
                    state[5] += len(template)
                    state[6] += len(ids)
            if state:
                yield summary(state)

        return batches_of(rows(), _READ)

    return formatted.mapInArrow(read, READ_SCHEMA)
