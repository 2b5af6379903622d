"""Exact dedup with a cuckoo-filter index of live digests.

A row's digest is the SHA-256 of its text without ASCII white space. Rows are counted on the JVM for each (digest, salt) first,
so a text that a third of the rows hold reaches its bucket as at most SALTS rows. Buckets of digests then go through
CuckooIndex: a filter of 16-bit fingerprints says "surely new" or "maybe there", maybes are verified against the bucketed
content (the stored digests with their keepers), better keepers replace the stored entry by delete and insert, and an overflow
rebuilds the filter at twice the size from the stored keys. The finished buckets are the index; it can be kept, extended by
insert() and reduced by delete(), each one co-grouped with its bucket.

Defined results: null counts as the empty text; of equal texts the one with the most code points stays, then the smallest doc_id
(a null doc_id after all others); repeated rows count in group_size and keep the same fate in dedup(), and keep() leaves one of
them; an empty table gives no rows; extra columns are not read by dedup() and pass through keep(), whatever their names; very long
texts are hashed whole on the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

SALTS = 16
ENTRY = "bucket int, digest binary, keep_id long, n_chars int, group_size long"


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each has two places, i and i xor hash(fingerprint)."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 64):
        n = 1
        while n * self.SLOTS * 0.85 < max(4, capacity):
            n *= 2
        self.mask, self.table, self.size = n - 1, np.zeros((n, self.SLOTS), np.uint16), 0
        self._turn = 1

    @staticmethod
    def _print(key: int) -> int:
        return (key >> 48 & 0xFFFF) or 1

    def _other(self, i: int, f: int) -> int:
        return (i ^ f * 0x5BD1E995) & self.mask

    def _places(self, key: int) -> tuple[int, int, int]:
        f, i = self._print(key), key & self.mask
        return f, i, self._other(i, f)

    def __contains__(self, key: int) -> bool:
        f, i, j = self._places(key)
        return f in self.table[i].tolist() or f in self.table[j].tolist()

    def insert(self, key: int) -> bool:
        """False if no place was found; one fingerprint is then homeless and the caller must rebuild."""
        f, i, j = self._places(key)
        for k in (i, j):
            row = self.table[k].tolist()
            if 0 in row:
                self.table[k, row.index(0)] = f
                self.size += 1
                return True
        k = j
        for _ in range(self.KICKS):
            self._turn = self._turn * 1103515245 + 12345 & 0x7FFFFFFF
            slot = self._turn >> 16 & 3
            f, self.table[k, slot] = int(self.table[k, slot]), f
            k = self._other(k, f)
            row = self.table[k].tolist()
            if 0 in row:
                self.table[k, row.index(0)] = f
                self.size += 1
                return True
        return False

    def delete(self, key: int) -> bool:
        """Removes one copy of a key that was inserted."""
        f, i, j = self._places(key)
        for k in (i, j):
            row = self.table[k].tolist()
            if f in row:
                self.table[k, row.index(f)] = 0
                self.size -= 1
                return True
        return False


class CuckooIndex:
    """Live digests of one bucket: a filter in front of the stored content, digest -> (keep_id, n_chars, group_size)."""

    def __init__(self, capacity: int = 64):
        self.filter, self.content, self.resizes = CuckooFilter(capacity), {}, 0

    @staticmethod
    def _key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def get(self, digest: bytes):
        return self.content.get(digest) if self._key(digest) in self.filter else None

    def _put(self, digest: bytes, entry: tuple) -> None:
        self.content[digest] = entry
        if not self.filter.insert(self._key(digest)):
            self._resize()

    def _resize(self) -> None:
        size = 2 * len(self.filter.table) * CuckooFilter.SLOTS
        while True:
            self.filter, self.resizes = CuckooFilter(size), self.resizes + 1
            if all(self.filter.insert(self._key(d)) for d in self.content):
                return
            size *= 2

    def insert(self, digest: bytes, keep_id, n_chars: int, count: int = 1) -> None:
        old = self.get(digest)
        if old is None:
            self._put(digest, (keep_id, n_chars, count))
            return
        best = min((old[:2], (keep_id, n_chars)), key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        if best != old[:2]:  # another keeper: the old entry goes, the new one comes
            self.delete(digest)
            self._put(digest, (*best, old[2] + count))
        else:
            self.content[digest] = (*old[:2], old[2] + count)

    def delete(self, digest: bytes) -> bool:
        if self.get(digest) is None:
            return False
        del self.content[digest]
        return self.filter.delete(self._key(digest))


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), common.SPACE, "")


def _digest_columns() -> list:
    return ["doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original text) and the digest of each row, all on the JVM."""
    return docs.select(*_digest_columns())


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(buckets)).cast("int")


def _best():
    """Most code points first, then the smallest doc_id, a null one last."""
    return F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("null"), F.col("doc_id")))


def _entries(index: CuckooIndex, bucket: int) -> pd.DataFrame:
    rows = [(bucket, d, *e) for d, e in index.content.items()]
    out = pd.DataFrame(rows, columns=["bucket", "digest", "keep_id", "n_chars", "group_size"])
    out["keep_id"] = out["keep_id"].astype("Int64")
    return out


def _fill(index: CuckooIndex, pdf: pd.DataFrame) -> None:
    for d, i, n, c in zip(pdf["digest"], pdf["keep_id"], pdf["n_chars"], pdf["group_size"], strict=True):
        index.insert(bytes(d), None if pd.isna(i) else int(i), int(n), int(c))


def _partial(rows: DataFrame, buckets: int) -> DataFrame:
    """At most SALTS rows for each digest, counted before the shuffle as well."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    g = rows.groupBy("digest", salt.alias("salt")).agg(F.count(F.lit(1)).alias("group_size"), _best().alias("best"))
    return g.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).cast("int").alias("n_chars"), "group_size")


def buckets_for(rows: DataFrame, per_bucket: int = 50_000) -> int:
    """So many buckets that each holds about per_bucket digests at most, whatever the size of the table."""
    n = rows.agg(F.approx_count_distinct("digest", 0.05)).first()[0]
    return max(common.parallelism(rows.sparkSession), -(-n // per_bucket))


def build_index(rows: DataFrame, buckets: int) -> DataFrame:
    """The index of digests(): one row for each live digest, by bucket."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex(len(pdf) // 2)
        _fill(index, pdf)
        return _entries(index, int(key[0]))

    return _partial(rows, buckets).groupBy("bucket").applyInPandas(build, ENTRY)


def _merge(index: DataFrame, other: DataFrame, act) -> DataFrame:
    def run(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        own = CuckooIndex(len(old))
        _fill(own, old)
        act(own, new)
        return _entries(own, int(key[0]))

    return index.groupBy("bucket").cogroup(other.groupBy("bucket")).applyInPandas(run, ENTRY)


def insert(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """The index with the digests of more rows."""
    return _merge(index, _partial(rows, buckets), _fill)


def delete(index: DataFrame, rows: DataFrame, buckets: int) -> DataFrame:
    """The index without the given digests (column digest), whatever their counts."""

    def act(own: CuckooIndex, pdf: pd.DataFrame) -> None:
        for d in pdf["digest"]:
            own.delete(bytes(d))

    return _merge(index, rows.select("digest").distinct().select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest"), act)


def _indexed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' digests, and the same with what the index says of them."""
    own = common.documents(docs)
    rows = common.materialise(own.select(*common.identity(), "*").select("row_key", "text_key", *_digest_columns()), "digests")
    index = common.materialise(build_index(rows, buckets_for(rows)), "cuckoo-index")
    right = index.select("digest", "keep_id", "group_size", F.col("n_chars").alias("keep_chars"))
    return rows, common.join_by_key(rows, right, "digest", "group_size", rows.count())


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    _, told = _indexed(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return told.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts one, also where ids are null or repeat."""
    rows, told = _indexed(docs)
    first = told.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")))
    best = first.groupBy("digest").agg(F.min(F.struct("row_key", "text_key")).alias("first")).select("first.row_key", "first.text_key")
    kept = common.materialise(best, "kept")
    out = common.kept_rows(docs, kept)
    if rows.groupBy("row_key", "text_key").count().filter("count > 1").take(1):
        out = out.dropDuplicates(["doc_id", "text"])
    return out
