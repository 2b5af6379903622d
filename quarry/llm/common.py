"""What the operators share: the shared folder, materialised tables, word hashing and byte kernels."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage
from quarry.storage import release, scope, scratch  # noqa: F401

#: ASCII white space as the contracts name it: blank and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
U64 = np.uint64


#: Bytes of an Arrow batch on its way to Python, whatever the number of its rows: long texts and packed blocks make large rows.
BATCH_BYTES = 8 << 20


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialise(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """storage.materialise(), with the session's Arrow batches bounded."""
    _bound_batches(df.sparkSession)
    return storage.materialise(df, name, codec, rows, per_file)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only, on the JVM."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_LOWER = {i: i + 32 for i in range(65, 91)}
_LOWER_BYTES = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z and leaves every other character as it is."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    """Maximal runs of characters that are no ASCII white space."""
    if not text:
        return []
    # str.split() also splits at Unicode spaces; only the six ASCII ones count here.
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return WORD.findall(text)


CACHES: list[dict] = []


class HashCache(dict):
    """word -> 64-bit hash. Bounded in bytes: emptied at `limit` words, none longer than LONG is kept, and emptied after each task."""

    LONG = 64

    def __init__(self, limit: int = 250_000):
        self.limit = limit
        CACHES.append(self)

    def make(self, word) -> int:
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))

    def __missing__(self, word) -> int:
        h = self.make(word)
        if len(word) <= self.LONG:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


_HASHES = HashCache()


def clear_caches() -> None:
    for c in CACHES:
        c.clear()


def emptied(run):
    """run, a function over batches, with the worker's caches emptied at its end: Python workers live on and serve other stages."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            clear_caches()

    return outer


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=U64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix): every input bit reaches every output bit."""
    h = h.astype(U64, copy=True)
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BASE = U64(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values of h, in order."""
    if n < 1 or len(h) < n:
        return np.empty(0, U64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out *= _BASE
        out += h[i : i + m]
    return mix(out + U64(n))


def crc_of_id(doc_id) -> int:
    """crc32 of the id's decimal text; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def cover(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Marks positions 0..n-1 that lie in [s, s + length) for any s in starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator needs; a clashing extra column stays out of every join. Bounds the session's Arrow batches."""
    _bound_batches(df.sparkSession)
    return df.select("doc_id", "text", *more)


def identity() -> list:
    """What tells rows of (doc_id, text) apart in a few bytes: the id (for a null one a hash of the text), and a hash of the text."""
    t = F.xxhash64("text")
    return [F.coalesce("doc_id", t).alias("row_key"), t.alias("text_key")]


def kept_rows(docs: DataFrame, kept: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of docs, with all their columns, of which identity() is (left_anti: is not) in kept (row_key, text_key)."""
    kept = kept.select(F.col("row_key").alias("quarry_row"), F.col("text_key").alias("quarry_text"))
    row, text = identity()
    return docs.join(kept, row.eqNullSafe(kept["quarry_row"]) & text.eqNullSafe(kept["quarry_text"]), how)


#: A key counts as hot with one row in HOT: there are HOT such keys at most, a bound of what is broadcast.
HOT = 2000


def join_by_key(rows: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with right on `key`, of which right has each once, with its number of rows in `size`.

    The hot keys of right are broadcast, so their rows stay where they are; only the others are shuffled.
    """
    least = max(1, total // HOT)
    hot = F.broadcast(right.filter(F.col(size) > least).withColumnRenamed(key, "quarry_key"))
    cold = right.filter(F.col(size) <= least).withColumnRenamed(key, "quarry_key")
    same = F.col(key) == F.col("quarry_key")
    names = [*rows.columns, *(c for c in right.columns if c != key)]
    some = rows.join(hot, same).select(*names)
    rest = rows.join(hot.select("quarry_key"), same, "left_anti").join(cold, same, how).select(*names)
    return some.unionByName(rest)


PARTS, _CHUNK, _FAN = "part long, chunk int, data binary", 1 << 15, 64


def parts_of_sum(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's share of a sum of counts (int64), in chunks; nothing where all are zero."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k in range(0, len(total), _CHUNK):
        piece = total[k : k + _CHUNK]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k // _CHUNK], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["part", "chunk", "data"])


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks' PARTS, by a tree: no task adds up more than _FAN pieces of a chunk, and the driver one for each _FAN ** 2 tasks."""

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "chunk": [key[1]], "data": [sum(np.frombuffer(x, np.int64) for x in pdf["data"]).tobytes()]}).astype({"part": "int64", "chunk": "int32"})

    for _ in range(2):
        rows = rows.groupBy(F.floor(F.col("part") / _FAN).alias("part"), "chunk").applyInPandas(add, PARTS)
    out = np.zeros(size, np.int64)
    for r in rows.collect():
        piece = np.frombuffer(r.data, np.int64)
        out[r.chunk * _CHUNK : r.chunk * _CHUNK + len(piece)] += piece
    return out
