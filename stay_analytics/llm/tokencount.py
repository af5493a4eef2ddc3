"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at each place
of a word; the dynamic program keeps, for each place, the best score of a
segmentation up to there, its number of pieces and whether it ends in an
unknown character. Ties go the way of the ``tokenizers`` unigram model: the
piece that starts first wins, a character is unknown only where no piece is
that character alone, and neighbouring unknown characters are one token.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_bytes

# Fixed values of unigram tokenizers: the mark before a word, and by how much an unknown character scores below the worst piece.
WORD_MARK, UNKNOWN_PENALTY = "▁", 10.0
#: Distinct words whose counts a Python worker keeps at most.
CACHED_WORDS = 300_000


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece model file with scores: the log of the Zipf weight of the piece's place in the file.

    Control, unknown and byte pieces are left out. Nothing is trained.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(piece, -log(place + 2.0)) for place, piece in enumerate(plain)]


class Unigram(dict):
    """Word -> (pieces, score) under a vocabulary of (piece, score), kept up to ``most`` words."""

    def __init__(self, vocabulary: list[tuple[str, float]], most: int = CACHED_WORDS):
        import ahocorasick

        super().__init__()
        self.most = most
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.matches = self.automaton.iter if len(self.automaton) else lambda word: ()

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of a word as it is (no mark is added)."""
        n = len(word)
        ends: list[list] = [[] for _ in range(n)]
        for end, piece in self.matches(word):  # at each end, longer pieces come first
            ends[end].append(piece)
        best, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            alone = False
            for length, score in ends[end - 1]:
                s = score + best[end - length]
                if top is None or s > top:
                    top, start = s, end - length
                alone = alone or length == 1
            if not alone and (top is None or self.unknown + best[end - 1] > top):
                best[end] = self.unknown + best[end - 1]
                pieces[end] = pieces[end - 1] + (not unknown[end - 1])
                unknown[end] = True
            else:
                best[end], pieces[end] = top, pieces[start] + 1
        return pieces[n], best[n]

    def __missing__(self, word: bytes) -> tuple[int, float]:
        out = self.count(WORD_MARK + word.decode())
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


@lru_cache(maxsize=2)
def unigram_of(path: str) -> Unigram:
    return Unigram(unigram_vocabulary(path))


def count_tokens(docs: DataFrame, path: str, out: tuple[str, str, str] = ("n_words", "n_tokens", "token_score")) -> DataFrame:
    """``docs`` with words, tokens and summed log score of ``text`` in three more columns (of those names, replaced).

    Words are runs without white space (space, \\x09-\\x0D); each is marked and
    segmented by itself. Null and empty texts count 0. No shuffle; equal texts
    have equal counts. ``path`` must be readable on executors.
    """
    rows = docs.select(*[c for c in docs.columns if c.lower() not in {o.lower() for o in out}])
    schema = T.StructType([*rows.schema.fields, T.StructField(out[0], T.LongType()), T.StructField(out[1], T.LongType()), T.StructField(out[2], T.DoubleType())])

    def run(batches):
        counts = unigram_of(path)
        for part, texts in text_bytes(batches):
            found = []
            for t in texts:
                each = [counts[w] for w in t.split()] if t else []
                found.append((len(each), sum([c for c, _ in each]), sum([s for _, s in each], 0.0)))
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([f[k] for f in found], pa.float64() if k == 2 else pa.int64()) for k in range(3)]],
                                             names=[*part.schema.names, *out])

    return rows.mapInArrow(run, schema)
