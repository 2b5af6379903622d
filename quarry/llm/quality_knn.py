"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text is a bag of hashed terms of two kinds: its words, and how it is written - word shapes (letters by case, marks as they are),
pairs of shapes, and how often words and lines repeat. Each kind has DIMENSIONS rows of the term-document matrix; term weights are
square-rooted rates times inverse document frequency, words count WORD_SHARE of it. A truncated singular value decomposition of the
labelled rows gives RANK latent dimensions. The labelled vectors are broadcast (FIT_ROWS * RANK floats, a fixed bound) and every
document is compared with all of them by exact cosine products, block by block; the NEIGHBOURS nearest vote with weight
similarity ** SHARPNESS. Similarities that agree to nine digits tie, and the smaller doc_id is the nearer.

The fit uses at most FIT_ROWS labelled rows, those with the least hash of doc_id among rows that are not held out. Every document
is scored over its whole text. labels, lang, source and doc_id are never inputs of a score.

Defined results: null, empty and blank texts score the mean label of the fit; a null doc_id is held out by the crc32 of an empty
text; repeated rows are scored each; without any labels every score is 0.5; an empty table gives no rows; extra columns are not
read by score() and pass through keep(); labels that are null are ignored, and of several labels for a doc_id the least counts; of
rows that repeat a labelled doc_id the text with the least hash is learned from; very long texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

FIT_ROWS, DIMENSIONS, RANK, NEIGHBOURS, SHARPNESS, THRESHOLD = 4096, 1024, 48, 15, 16, 0.3
WORD_SHARE = 0.3
FOLDS = 5

_SHAPE = bytearray(range(256))
for _i in range(256):
    c = chr(_i)
    if _i >= 128 or "a" <= c <= "z":
        _SHAPE[_i] = ord("x")
    elif "A" <= c <= "Z":
        _SHAPE[_i] = ord("X")
    elif "0" <= c <= "9":
        _SHAPE[_i] = ord("9")
    elif _i < 32:
        _SHAPE[_i] = ord("\n") if c == "\n" else 32
_SHAPE = bytes(_SHAPE)
_RUNS = re.compile(rb"([xX9])\1+")


class _Dims(common.HashCache):
    def make(self, term) -> int:
        return zlib.crc32(term if isinstance(term, bytes) else b"\0".join(term)) % DIMENSIONS


_SHAPES, _WORDS = _Dims(50_000), _Dims(100_000)


def features(text: str | None) -> np.ndarray:
    """Square-rooted rates of the text's hashed terms: of its shapes, then of its words."""
    out = np.zeros(2 * DIMENSIONS, np.float32)
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    shapes = _RUNS.sub(rb"\1", data.translate(_SHAPE)).split()
    counts = Counter(shapes)
    counts.update(zip(shapes, shapes[1:]))
    n = len(words)
    lines = [x for x in data.split(b"\n") if x]
    counts[b" again"] = 2 * sum(map(eq, words, words[1:]))
    counts[b" line again"] = n * (len(lines) - len(set(lines))) // max(1, len(lines))
    distinct = len(set(words)) / n ** 0.85  # few distinct words for the length
    counts[b" poor"] = int(n * max(0.0, 1 - distinct))
    np.add.at(out, [_SHAPES[t] for t in counts], np.fromiter(counts.values(), np.float32, len(counts)))
    out[DIMENSIONS:] = np.bincount(np.fromiter(map(_WORDS.__getitem__, words), np.int64, n), minlength=DIMENSIONS)
    return np.sqrt(out / n)


class Model:
    """Inverse document frequencies, latent dimensions, and the labelled vectors."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, rank: int = RANK):
        self.labels = labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(rows):
            rows = np.zeros((0, 2 * DIMENSIONS), np.float32)
        self.idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
        x = self._weighted(rows).astype(np.float64)
        self.axes = _right_singular(x, rank)
        self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def _weighted(self, rows: np.ndarray) -> np.ndarray:
        x = rows * self.idf
        shapes, words = self._unit(x[:, :DIMENSIONS]), self._unit(x[:, DIMENSIONS:])
        return np.hstack([shapes * np.float32(1 - WORD_SHARE) ** 0.5, words * np.float32(WORD_SHARE) ** 0.5])

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors for a block of feature rows."""
        out = np.full(len(rows), self.prior)
        if not len(self.labels) or not len(rows):
            return out
        v = self._unit(self._weighted(rows).astype(np.float64) @ self.axes)
        sims = v @ self.vectors.T
        n, k = sims.shape[1], min(NEIGHBOURS, sims.shape[1])
        # One integer for similarity and place: the labelled rows are in order of doc_id, so ties go to the smaller one.
        key = np.rint(sims * 1e9).astype(np.int64) * n - np.arange(n)
        near = np.argpartition(-key, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, near, 1), 0) ** SHARPNESS
        total = w.sum(1)
        known = (total > 0) & rows.any(1)
        out[known] = (w * self.labels[near]).sum(1)[known] / total[known]
        return np.clip(out, 0.0, 1.0)


def _right_singular(x: np.ndarray, rank: int, rounds: int = 12) -> np.ndarray:
    """The `rank` leading right singular vectors of x, by subspace iteration from a fixed start."""
    rank = min(rank, x.shape[1])
    gram = x.T @ x
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(x.shape[1], rank + 16)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(gram @ q)
    values, v = np.linalg.eigh(q.T @ gram @ q)
    return (q @ v[:, ::-1])[:, :rank]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the labelled rows that are not held out."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    chosen = labels.filter("doc_id is not null and quality is not null").filter(remainder != 0).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [features(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(data, pa.binary()), b.column(3)], ["doc_id", "text_key", "row", "quality"])

    # At most fit_rows ids are broadcast, and as many feature rows come back.
    sample = common.documents(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.col("quality").cast("int").alias("quality"))
    sample = sample.mapInArrow(common.emptied(extract), "doc_id long, text_key long, row binary, quality int")
    rows = sample.groupBy("doc_id").agg(F.min_by("row", "text_key").alias("row"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    x = np.frombuffer(b"".join(r.row for r in rows), np.float32).reshape(-1, 2 * DIMENSIONS)
    return Model(x, np.array([r.quality for r in rows], np.float64))


def score(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; the fit reads the texts of fit_on (docs, unless given)."""
    docs = common.documents(docs)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if fit_on is None else fit_on, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                s = model.value.score(np.stack([features(t.as_py()) for t in part.column(1)]))
                held = [common.crc_of_id(i) % FOLDS == 0 for i in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(common.emptied(run), "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted to be of quality."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                s = model.value.score(np.stack([features(t.as_py()) for t in part.column(at)]))
                yield part.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(common.emptied(run), docs.schema)
