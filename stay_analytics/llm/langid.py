"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of a fixed-length window; each
filter's largest response in the window is kept, and a softmax layer turns
them into language probabilities. It is trained here in numpy on a bounded
sample of labelled windows; whole texts are then read window by window, and a
document's probabilities are the mean over its windows, weighted by bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_bytes
from .hashing import TO_LOWER

WINDOW_BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The sample to learn from: documents of each language, and windows of each document, at most.
DOCUMENTS_PER_LANGUAGE = 400
WINDOWS_PER_DOCUMENT = 4
STEPS, BATCH, RATE = 500, 128, 0.01
UNKNOWN = "und"


@dataclass
class ByteCNN:
    """languages; filters[w]: (w, 256, FILTERS) responses to each byte at each place; bias; dense layer."""

    languages: list[str]
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray, places: bool = False):
        """Largest response of each filter in each window (rows of bytes), and where, if asked for."""
        best, where = [], []
        for w, f in self.filters.items():
            n = windows.shape[1] - w + 1
            r = f[0][windows[:, :n]]
            for j in range(1, w):
                r += f[j][windows[:, j:j + n]]
            if places:
                at = r.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
            else:
                best.append(r.max(axis=1))
        x = np.concatenate(best, axis=1) + self.bias
        return (x, where) if places else x

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(np.maximum(self.pooled(windows), 0) @ self.dense + self.dense_bias)

    def paired(self) -> "PairTables":
        return PairTables(self)


class PairTables:
    """The same network with one lookup for every two bytes: widths 2, 3 and 4 take one or two lookups."""

    def __init__(self, net: ByteCNN):
        self.net = net
        self.first = np.concatenate([(f[0][:, None] + f[1][None]).reshape(65536, -1) for f in net.filters.values()], axis=1).astype(np.float32)
        self.rest = {w: (f[2] if w == 3 else (f[2][:, None] + f[3][None]).reshape(65536, -1)).astype(np.float32) for w, f in net.filters.items() if w > 2}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        pairs = (windows[:, :-1].astype(np.int32) << 8) | windows[:, 1:]
        best = []
        base = self.first[pairs]
        for k, w in enumerate(self.net.filters):
            r = base[:, :windows.shape[1] - w + 1, k * FILTERS:(k + 1) * FILTERS]
            if w == 3:
                r = r + self.rest[3][windows[:, 2:]]
            elif w == 4:
                r = r + self.rest[4][pairs[:, 2:]]
            best.append(r.max(axis=1))
        x = np.maximum(np.concatenate(best, axis=1) + self.net.bias, 0)
        return softmax(x @ self.net.dense + self.net.dense_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: bytes, size: int = WINDOW_BYTES) -> np.ndarray:
    """A text as rows of ``size`` bytes with A-Z folded, the last one filled with zeros; one row for an empty text."""
    n = max(1, -(-len(text) // size))
    return TO_LOWER[np.frombuffer(text.ljust(n * size, b"\0"), dtype=np.uint8)].reshape(n, size)


def train(windows: np.ndarray, labels: list[str], steps: int = STEPS, seed: int = 7) -> ByteCNN:
    """A network from rows of bytes and their languages, by Adam on batches balanced over languages.

    A single language gives a network that always answers it; no rows give one without languages.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    n = len(languages)
    net = ByteCNN(languages, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS},
                  np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)).astype(np.float32), np.zeros(n, np.float32))
    if n < 2:
        return net
    of = np.array([languages.index(x) for x in labels])
    rows = [np.flatnonzero(of == k) for k in range(n)]
    params = [*net.filters.values(), net.bias, net.dense, net.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(r, -(-BATCH // n)) for r in rows])
        x, y = windows[pick], of[pick]
        z, where = net.pooled(x, places=True)
        a = np.maximum(z, 0)
        d = softmax(a @ net.dense + net.dense_bias)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ net.dense.T) * (z > 0)
        grads = []
        for k, (w, f) in enumerate(net.filters.items()):  # only the places of the largest responses matter
            g, part = np.zeros_like(f), back[:, k * FILTERS:(k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, where[k] + j, axis=1), np.arange(FILTERS)[None]), part)
            grads.append(g)
        grads += [back.sum(0), a.T @ d, d.sum(0)]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def remainder(doc_id):
    """crc32 of the id as text, modulo 3: documents of remainder 1 are held out."""
    return F.crc32(doc_id.cast("string")) % 3


def learn(docs: DataFrame, most: int = DOCUMENTS_PER_LANGUAGE, per_document: int = WINDOWS_PER_DOCUMENT) -> ByteCNN:
    """Train on at most ``most`` documents of each language that are not held out, ``per_document`` windows of each.

    Chosen by hash of the id. Only those windows (256 bytes each) come to the
    driver. Rows without id, text or language are not learned from.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(remainder(F.col("doc_id")) != 1)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r.doc_id for r in known.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("doc_id").collect()]

    def spread(frames):
        for f in frames:
            rows = [(doc, lang, w[k].tobytes()) for doc, lang, t in zip(f.doc_id, f.lang, f.text, strict=True)
                    for w in (windows_of(t.encode()),) for k in np.unique(np.linspace(0, len(w) - 1, per_document).astype(int))]
            yield f.__class__(rows, columns=["doc_id", "lang", "window"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = known.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", "text").mapInPandas(spread, f"doc_id {key}, lang string, window binary").collect() if ids else []
    rows.sort(key=lambda r: (r.lang, r.doc_id, bytes(r.window)))
    data = np.frombuffer(b"".join(bytes(r.window) for r in rows), dtype=np.uint8).reshape(-1, WINDOW_BYTES)
    return train(data, [r.lang for r in rows])


ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return text is not None and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text.decode())))


def predict_batch(tables: PairTables, texts: list[bytes | None], chunk: int = 256) -> tuple[list[str], list[float]]:
    """Language and probability of each text; ``und`` and 0 for a null text or one without a letter."""
    net = tables.net
    said, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if has_letter(t)]
    if not known or not net.languages:
        return said, score
    windows = np.concatenate([windows_of(texts[k]) for k in known])
    counts = np.array([max(1, -(-len(texts[k]) // WINDOW_BYTES)) for k in known])
    weight = np.full(len(windows), WINDOW_BYTES, dtype=np.float64)
    ends = np.cumsum(counts)
    weight[ends - 1] = [len(texts[k]) - (c - 1) * WINDOW_BYTES for k, c in zip(known, counts, strict=True)]
    p = np.concatenate([tables.probabilities(windows[i:i + chunk]) for i in range(0, len(windows), chunk)]) * weight[:, None]
    total = np.add.reduceat(p, ends - counts, axis=0) / np.add.reduceat(weight, ends - counts)[:, None]
    for k, row in zip(known, total, strict=True):
        best = int(row.argmax())
        said[k], score[k] = net.languages[best], float(min(max(row[best], 0.0), 1.0))
    return said, score


def identify(docs: DataFrame, net: ByteCNN, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language of ``text`` and its probability in two more columns (of those names, replaced). No shuffle.

    A null text or one without a letter is ``und`` with score 0; on a tie the
    language first by name wins. Equal texts get equal answers.
    """
    kept = [c for c in docs.columns if c.lower() not in (lang.lower(), score.lower())]
    rows = docs.select(*kept)

    def run(batches):
        tables = net.paired()
        for part, texts in text_bytes(batches):
            said, p = predict_batch(tables, texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string()), pa.array(p, pa.float64())], names=[*part.schema.names, lang, score])

    schema = T.StructType([*rows.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(run, schema)
