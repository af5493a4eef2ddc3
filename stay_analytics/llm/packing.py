"""Sum-of-squares packing of tokenized documents into fixed windows.

A document is cut into whole windows and one remainder. Remainders are placed
online: among the fill levels at which an open window has room, the one is
taken that makes the sum over levels of (open windows at that level) squared
smallest. The counts by level are one array of ``window`` numbers. Each input
partition packs its own documents, so nothing is shuffled and a lost task is
simply run again; what its open windows hold at the end is joined and cut anew
into whole windows, and the last rest into powers of two, so that no sequence
needs padding.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

WINDOW = 2048
END_ID = 1
#: So many windows stay open at most; beyond it they are joined and cut anew.
OPEN_WINDOWS = 2048
#: Distinct chunks of text whose ids a Python worker keeps at most.
CACHED_CHUNKS = 200_000
#: Sequence numbers of one partition start here times its number.
SEQUENCES_PER_PARTITION = 1 << 40

# Fixed value: the split pattern that byte-level BPE vocabularies of this kind are defined with.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between spaces or before the end: there the plain split at spaces would cut a run of white space.
RUN_OF_SPACES = re.compile(r"\s (?:\s|\Z)")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Encoder of a ``tokenizers`` file with a byte-level BPE model, equal to that library's ids between added tokens.

    Ranks are the ids of the file's vocabulary.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in saved["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in saved["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(path: str) -> tuple[re.Pattern | None, dict[str, bytes]]:
    """What finds the added tokens of a ``tokenizers`` file in a text, and their ids as bytes."""
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    added = saved["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")) or (saved["normalizer"] and any(t["normalized"] for t in added)):
        raise ValueError(f"{path}: only added tokens that match as they are written are supported")
    ids = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in added if t["content"]}
    return re.compile(f"({'|'.join(map(re.escape, sorted(ids, key=len, reverse=True)))})") if ids else None, ids


class Chunks(dict):
    """Chunk of text -> its ids as little-endian unsigned 32-bit bytes, kept up to ``most`` chunks."""

    def __init__(self, path: str, most: int = CACHED_CHUNKS):
        super().__init__()
        self.encode, self.most = encoder(path).encode_ordinary, most
        self.added, self.added_ids = added_tokens(path)

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), dtype="<u4").tobytes() if len(chunk) > 200 else array("I", self.encode(chunk)).tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def library_ids(self, text: str) -> bytes:
        """Ids of a text as the library gives them by default: added tokens have their own, and part what stands around them."""
        if not self.added or not self.added.search(text):
            return self.ids(text)
        return b"".join([self.added_ids[t] if k % 2 else self.ids(t) for k, t in enumerate(self.added.split(text)) if t])

    def ids(self, text: str) -> bytes:
        """Ids of a text without added tokens, or with them as ordinary text. Every token lies in one chunk: no token goes past a space that follows other text."""
        if RUN_OF_SPACES.search(text):
            return b"".join([self[c] for c in BEFORE_SPACE.split(text)])
        first, *rest = text.split(" ")
        return b"".join([self[first], *[self[" " + c] for c in rest]]) if first else b"".join([self[" " + c] for c in rest])


@lru_cache(maxsize=2)
def chunks_of(path: str) -> Chunks:
    return Chunks(path)


class Packer:
    """Packs pieces into windows; ``done`` gathers (piece, sequence, offset)."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN_WINDOWS, first: int = 0):
        self.window, self.most_open, self.next = window, most_open, first
        self.levels = np.zeros(window + 1, dtype=np.int64)  # open windows by fill level
        self.open: dict[int, list[list]] = {}  # level -> windows: lists of pieces
        self.n_open, self.done = 0, []

    def close(self, pieces: list) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def level_for(self, size: int) -> int:
        """The level that minimises the sum of squares; the fullest on a tie. 0: a new window."""
        n, w = self.levels, self.window
        change = 1 - 2 * n[:w - size + 1]  # a window leaves its level
        change[0] = 0
        change[:w - size] += 2 * n[size:w] + 1  # and joins a higher one; full windows do not count
        room = n[:w - size + 1] > 0
        room[0] = True
        change[~room] = np.iinfo(np.int64).max
        return w - size - int(np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        """Pack a document: its id and its ids as bytes. A piece is (doc, start, length, bytes, tokens of the document)."""
        n, w = len(ids) // 4, self.window
        for start in range(0, n - w + 1, w):
            self.close([(doc, start, w, ids[4 * start:4 * (start + w)], n)])
        size = n % w
        if not size:
            return
        level = self.level_for(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        pieces.append((doc, n - size, size, ids[4 * (n - size):], n))
        if level + size == w:
            self.close(pieces)
            return
        self.levels[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        self.n_open += 1
        if self.n_open > self.most_open:
            self.consolidate()

    def consolidate(self, last: bool = False) -> None:
        """Join the open windows, fullest first, and cut them into whole ones; at the end the rest into powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left, cut, held = sum(p[2] for p in pieces), [], 0
        room = self.window if left >= self.window or not last else 1 << (left.bit_length() - 1) if left else 0
        for doc, start, length, ids, n in pieces:
            while length:
                take = min(length, room - held)
                cut.append((doc, start, take, ids[:4 * take], n))
                start, length, ids, held, left = start + take, length - take, ids[4 * take:], held + take, left - take
                if held == room:
                    self.close(cut)
                    cut, held = [], 0
                    room = self.window if left >= self.window or not last else 1 << (left.bit_length() - 1) if left else 0
        if cut:
            self.levels[held] = self.n_open = 1
            self.open[held] = [cut]


def pieces_schema(key_type) -> str:
    return f"doc_id {key_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, most_open: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece of the packed documents of ``docs`` (doc_id, text; other columns are ignored).

    Each document's ids are those that ``tokenizers`` gives for its text by
    default, added tokens such as ``<|endoftext|>`` included, then ``end_id``; a null or
    empty text has only that. Repeated rows are packed as documents of their
    own. A text of any length is cut into whole windows and a remainder. An
    empty table gives an empty result. ``path`` must be readable on executors.
    """
    key = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def pack(batches):
        chunks, packer, schema = chunks_of(path), Packer(window, most_open, TaskContext.get().partitionId() * SEQUENCES_PER_PARTITION), None

        def out():
            done, packer.done = packer.done, []
            return batch_of({"doc_id": [p[0] for p, _, _ in done], "start": [p[1] for p, _, _ in done], "length": [p[2] for p, _, _ in done],
                             "ids_crc32": [zlib.crc32(p[3]) for p, _, _ in done], "doc_tokens": [p[4] for p, _, _ in done],
                             "sequence_id": [s for _, s, _ in done], "offset": [o for _, _, o in done]}, schema)

        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field("doc_id").type), *[(c, pa.int64()) for c in (
                "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, (chunks.library_ids(text.as_py()) if text.is_valid else b"") + end)
                if len(packer.done) >= 4096:
                    yield out()
        packer.consolidate(last=True)
        chunks.clear()  # workers live on and share an executor's memory
        if packer.done:
            yield out()

    return docs.select("doc_id", F.col("text")).mapInArrow(pack, pieces_schema(key))
