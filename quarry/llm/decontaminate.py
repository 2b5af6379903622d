"""Benchmark decontamination by winnowing.

Every item window of WINDOW words is covered by a fingerprint: the least hash of K-word grams in each sliding window of
WINDOW - K + 1 grams. A document that shares a span of WINDOW words with an item therefore shares a fingerprint with it, in
the same place of the span. Document fingerprints are joined with the items', and each hit is extended: the windows around it
are compared in full, and the words of matching windows are marked. Items shorter than WINDOW words are windows of their own
and are looked up whole, length by length.

Where the items have at most `max_windows` windows and as many bytes of text as that stands for (both summed up before anything
is fetched), their tables are made once and broadcast, and the join is a probe of the sorted fingerprints. With more, nothing is
broadcast: fingerprints of documents and items are shuffled and semi-joined by value, the windows around hits by their hash.
Words are compared by 64-bit hash.

Defined results: null has no words; an item without words matches nothing; repeated rows of items count once, repeated
documents are judged each; a null item_id is left out of the ids but its windows hit; an empty table of documents or items gives no
rows or no hits; very long texts are handled whole; extra columns are not read by judge() and pass through clean(), whatever their
names.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

WINDOW, K = 13, 8
MAX_WINDOWS, BYTES_PER_WINDOW = 1_000_000, 64
#: Words: runs without ASCII characters that are neither digits nor letters.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_BLANK = {i: 32 for i in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]} | {i: i + 32 for i in range(65, 91)}
_TABLE = bytes(_BLANK.get(i, i) for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, as UTF-8: bytes over 0x7F are never separators, so one byte table does both."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ") if text else []


class _Hashes(common.HashCache):
    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


_HASHES = _Hashes()


def hashes_of(text: str | None) -> np.ndarray:
    w = [x for x in words_of(text) if x]
    return np.fromiter(map(_HASHES.__getitem__, w), np.uint64, len(w))


def winnow(h: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of grams) and values of the fingerprints of a sequence of word hashes: the rightmost least gram of each window."""
    g = common.gram_hashes(h, k)
    w = window - k + 1
    if not len(g):
        return np.empty(0, np.int64), g
    if len(g) <= w:
        at = np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
        return at, g[at]
    least = np.lib.stride_tricks.sliding_window_view(g, w)[:, ::-1].argmin(1)
    at = np.unique(np.arange(len(g) - w + 1) + w - 1 - least)
    return at, g[at]


def windows_around(h: np.ndarray, at: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows that hold a whole gram at one of the places `at`."""
    near = (at[:, None] - np.arange(window - k + 1)).ravel()
    near = np.unique(near[(near >= 0) & (near <= len(h) - window)])
    whole = h[near].copy()
    for i in range(1, window):
        whole = whole * common._BASE + h[near + i]
    return near, common.mix(whole + np.uint64(window))


class Items:
    """The windows of a block of items, by fingerprint and in full."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        of, prints = defaultdict(set), [np.empty(0, np.uint64)]
        short = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            h = hashes_of(text)
            if len(h) >= window:
                prints.append(winnow(h, window, k)[1])
                for x in common.gram_hashes(h, window).tolist():
                    of[x].add(item)
            elif len(h):
                short[len(h)][int(common.gram_hashes(h, len(h))[0])].add(item)
        self.prints = np.unique(np.concatenate(prints))
        self.of, self.keys = dict(of), np.array(sorted(of), np.uint64)
        self.short = {n: (dict(d), np.array(sorted(d), np.uint64)) for n, d in short.items()}

    @staticmethod
    def _within(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(x), bool)
        return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x

    def marks(self, h: np.ndarray) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items of which some window occurs."""
        hit, found = np.zeros(len(h), bool), set()
        self.whole = False  # whether a full window is among the hits
        if len(h) >= self.window and len(self.prints):
            at, prints = winnow(h, self.window, self.k)
            at = at[self._within(self.prints, prints)]
            if len(at):
                near, whole = windows_around(h, at, self.window, self.k)
                ok = self._within(self.keys, whole)
                hit |= common.cover(near[ok], self.window, len(h))
                self.whole = bool(ok.any())
                for x in set(whole[ok].tolist()):
                    found |= self.of[x]
        for n, (of, keys) in self.short.items():
            g = common.gram_hashes(h, n)
            at = np.flatnonzero(self._within(keys, g))
            if len(at):
                hit |= common.cover(at, n, len(h))
                for x in set(g[at].tolist()):
                    found |= of[x]
        return hit, found


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted({str(i) for i in items if i is not None})).encode()).hexdigest()


def _worded(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").filter(F.length(F.coalesce("text", F.lit(""))) > 0).distinct()


def _small(items: DataFrame, most: int) -> bool:
    """Whether all items have at most `most` windows and a bounded text: separators bound the words, so the JVM can sum both up."""
    words = F.length(F.regexp_replace("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "")) + 1
    n, size = items.agg(F.sum(words), F.sum(F.octet_length("text"))).first()
    return (n or 0) <= most and (size or 0) <= most * BYTES_PER_WINDOW


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]


def _row(doc_id, n: int, hit: int, items) -> tuple:
    items = {i for i in items if i is not None}
    return doc_id, n, hit, len(items), items_digest(items), hit > 0 and 20 * hit >= n


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def judge(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs."""
    items, docs = _worded(benchmark), common.documents(docs)
    if not _small(items, max_windows):
        return _joined(docs, items).select(*_NAMES)
    known = docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part, rows = b.slice(k, 1024), []
                for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    h = hashes_of(text.as_py())
                    hit, found = own.marks(h)
                    rows.append(_row(i, len(h), int(np.count_nonzero(hit)), found))
                yield _batch(rows, _NAMES, _KINDS)

    return docs.mapInArrow(common.emptied(run), SCHEMA)


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """judge() by shuffles alone, with row_key, text_key and `whole`, whether a full window is among a row's hits.

    Rows go through the joins as (row, place, hash): fingerprints first; where one is also an item's, the windows around it; and
    these again where an item has them. Items shorter than a window are looked up by grams of their own lengths.
    """
    keyed = common.materialise(docs.select(*common.identity(), "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "decontaminate")

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hashes_of(text.as_py())
                if not len(h):
                    continue
                n = min(len(h), WINDOW)
                whole = np.unique(common.gram_hashes(h, n))
                prints = np.unique(winnow(h)[1]) if n == WINDOW else whole[:0]
                size = len(whole) + len(prints)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if k is None else str(k)] * size, pa.string()), pa.array([n] * len(whole) + [0] * len(prints), pa.int32()), pa.array(np.concatenate([whole, prints]).view(np.int64))], ["item", "n", "hash"]
                )

    known = common.materialise(items.mapInArrow(common.emptied(of_items), "item string, n int, hash long").distinct(), "item-windows")
    short = sorted(r.n for r in known.filter((F.col("n") > 0) & (F.col("n") < WINDOW)).select("n").distinct().collect())  # 12 lengths at most

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hashes_of(text.as_py())
                parts = [(0, *winnow(h))] if len(h) >= WINDOW else []
                parts += [(n, np.arange(len(h) - n + 1), common.gram_hashes(h, n)) for n in short if len(h) >= n]
                for n, at, x in parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(x.view(np.int64))], ["row", "n", "at", "hash"])

    places = "row long, n int, at long, hash long"
    asked = keyed.select("row", "text").mapInArrow(common.emptied(of_docs), places)
    met = common.materialise(asked.join(known.select("n", "hash").distinct(), ["n", "hash"], "left_semi"), "fingerprint-hits")
    printed = met.filter("n = 0").groupBy("row").agg(F.collect_set("at").alias("at")).withColumnRenamed("row", "hit_row")  # places of one text

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                near, whole = windows_around(hashes_of(text.as_py()), at.values.to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), row)), pa.array(np.full(len(near), WINDOW, np.int32)), pa.array(near), pa.array(whole.view(np.int64))], ["row", "n", "at", "hash"])

    near = keyed.join(printed, F.col("row") == F.col("hit_row")).select("row", "text", "at").mapInArrow(common.emptied(extend), places)
    windows = near.join(known.filter(F.col("n") == WINDOW).select("hash").distinct(), "hash", "left_semi").select("row", "n", "at", "hash")
    hits = common.materialise(windows.unionByName(met.filter("n > 0").select("row", "n", "at", "hash")), "window-hits")
    marks = hits.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("hits"), F.bool_or(F.col("n") == WINDOW).alias("whole")).withColumnRenamed("row", "r1")
    found = hits.select("row", "n", "hash").distinct().join(known, ["n", "hash"]).filter("item is not null").groupBy("row").agg(F.collect_set("item").alias("items")).withColumnRenamed("row", "r2")
    joined = keyed.join(marks, F.col("row") == F.col("r1"), "left").join(found, F.col("row") == F.col("r2"), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row_key, text_key, i, text, at, whole, items in zip(*b.columns[:3], b.column(3), *b.columns[4:], strict=True):
                n = len(hashes_of(text.as_py()))
                hit = np.zeros(n, bool)
                for x in at.as_py() or []:
                    hit[x["at"] : x["at"] + x["n"]] = True
                rows.append((*_row(i.as_py(), n, int(np.count_nonzero(hit)), items.as_py() or []), row_key.as_py(), text_key.as_py(), bool(whole.as_py())))
            yield _batch(rows, [*_NAMES, "row_key", "text_key", "whole"], [*_KINDS, pa.int64(), pa.int64(), pa.bool_()])

    return joined.select("row_key", "text_key", "doc_id", "text", "hits", "whole", "items").mapInArrow(common.emptied(finish), SCHEMA + ", row_key long, text_key long, whole boolean")


def clean(docs: DataFrame, benchmark: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark passage.

    A passage is one full window of an item, however long the document: a twentieth of its words, as judge() has it, would let
    passages through in long documents. Items shorter than a window are often common phrases and count as judge() counts them.
    """
    items = _worded(benchmark)
    if not _small(items, max_windows):
        bad = _joined(common.documents(docs), items).filter("whole or contaminated").select("row_key", "text_key")
        return common.kept_rows(docs, common.materialise(bad.distinct(), "contaminated"), "left_anti")
    known, at = docs.sparkSession.sparkContext.broadcast(Items([(r.item_id, r.text) for r in items.collect()])), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part, ok = b.slice(k, 1024), []
                for text in part.column(at):
                    h = hashes_of(text.as_py())
                    n = int(np.count_nonzero(own.marks(h)[0]))
                    ok.append(not (own.whole or n > 0 and 20 * n >= len(h)))
                yield part.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(common.emptied(run), docs.schema)
