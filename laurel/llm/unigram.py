"""Token counts under a unigram vocabulary, without building the tokens.

Method: an Aho-Corasick automaton over the vocabulary gives all pieces that end at each character. Dynamic
programming over the end positions carries the best score so far and the number of pieces of that best path. Tie
rules are those of the tokenizer: among equal scores the earliest start (the longest piece) wins, a character
without a piece of its own scores ``least score - 10``, and such a character counts its bytes where the vocabulary
has all byte pieces, else a run of them counts one. Scores add up in double precision, left to right.

Spaces become space marks, one stands in front of the text, and the text is cut before every mark, as the tokenizer
does; the count of a part is remembered, so a frequent word is worked out once per process. With ``whole_runs`` a run
of marks stays with the word after it and the mark in front is always added, so that pieces of several marks count as
one, as in one search over the whole text: no piece holds a mark behind another character, so nothing is cut in two.

The vocabulary file is a parameter. The files at hand hold merge ranks as scores; they are read as log scores as
they stand, which gives a unigram tokenizer over the same pieces.

Defined cases: null and empty texts have no tokens. Texts are counted whole. Equal rows each give a row. Only the
named columns are read.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.common import per_text, utf8

MARK = "\u2581"
_RUN_AND_WORD = re.compile(f"{MARK}+[^{MARK}]*")
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000  # parts whose count is kept at a time; the store is emptied when full


class Unigram:
    """Count-only tokenizer over (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool) -> None:
        self.byte_pieces = byte_pieces
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.remembered: dict[str, int] = {}

    def count(self, text: str, whole_runs: bool = False) -> int:
        if not text:
            return 0
        if whole_runs:
            return self._count_runs(MARK + text.replace(" ", MARK))
        total, known = 0, self.remembered
        marked = text.replace(" ", MARK)
        for part in marked.removeprefix(MARK).split(MARK):  # a text that begins with a mark gets no second one
            n = known.get(part)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[part] = self.pieces_of(MARK + part)
            total += n
        return total

    def _count_runs(self, marked: str) -> int:
        total, known = 0, self.remembered  # these parts begin with a mark, those of ``count`` hold none
        for part in _RUN_AND_WORD.findall(marked):
            n = known.get(part)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[part] = self.pieces_of(part)
            total += n
        return total

    def pieces_of(self, part: str) -> int:
        """Number of pieces of the best path through ``part``."""
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(part) + 1)]
        for last, piece in self.automaton.iter(part):
            ending[last + 1].append(piece)
        best, pieces, in_unknown = [0.0], [0], False
        unknown_run = [False]
        for end in range(1, len(part) + 1):
            score = count = None
            in_unknown = single = False
            for length, value in sorted(ending[end], reverse=True):
                single = single or length == 1
                candidate = best[end - length] + value
                if score is None or candidate > score:
                    score, count = candidate, pieces[end - length] + 1
            if not single:
                candidate = best[end - 1] + self.unknown
                if score is None or candidate > score:
                    score, in_unknown = candidate, True
                    if self.byte_pieces:
                        count = pieces[end - 1] + len(part[end - 1].encode())
                    else:
                        count = pieces[end - 1] + (not unknown_run[end - 1])
            best.append(score)
            pieces.append(count)
            unknown_run.append(in_unknown)
        return pieces[-1]


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces and scores of a vocabulary file, without control, unknown and byte pieces; whether all byte pieces exist."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    n_bytes = sum(model.is_byte(i) for i in ids)
    plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], n_bytes == 256


_shared: dict[int, Unigram] = {}


def _model(vocabulary: Broadcast) -> Unigram:
    if vocabulary.value[2] not in _shared:
        _shared[vocabulary.value[2]] = Unigram(*vocabulary.value[:2])
    return _shared[vocabulary.value[2]]


def token_counts(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", whole_runs: bool = False) -> DataFrame:
    """One row per document: ``key``, code points and tokens. The vocabulary (one file) is broadcast."""
    pieces, byte_pieces = load_pieces(vocabulary_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast((pieces, byte_pieces, hash(vocabulary_path)))

    def count(raw: bytes) -> tuple[int, int]:
        value = raw.decode()
        return len(value), _model(vocabulary).count(value, whole_runs)

    kind = pa.struct([("n_chars", pa.int64()), ("n_tokens", pa.int64())])
    udf = per_text(count, kind)
    return docs.select(F.col(key), udf(utf8(text)).alias("counted")).select(key, "counted.*")


@functools.cache
def default_vocabulary() -> str:
    return "/opt/tokenizers/piece_bpe_32k.model"
