"""Suffix-array dedup of repeated byte strings, with external induced sorting (induced_sort.py).

A string of SPAN bytes is removed from a document if it also starts in one with a smaller doc_id. Equal strings must meet: each
SPAN-byte window has an anchor, the least hash of its GRAM-byte substrings, which depends on the window's bytes alone. So

1. documents become blocks (compressed rows of about BLOCK_BYTES); each block asks which of its anchors other documents have too;
2. runs of windows under one shared anchor are cut out as segments, equal ones once a block with their least doc_id, and go to
   the shard of their anchor; a shard concatenates its distinct segments, sorts their suffixes externally by induction, and
   adjacent suffixes with a common prefix of SPAN bytes or more are one string, whose least doc_id is sent back to the blocks;
   an anchor with more windows than an eighth of a shard's bytes is hot: its windows are dealt one by one, by a hash of all
   their SPAN bytes, to shards of their own, where equal ones meet and nothing is left to sort;
3. each block removes the windows of which the least doc_id is smaller than the document's own.

Shards are cut by SHARD_BYTES, queues beyond MEMORY spill to the shared folder. Anchors are 48-bit hashes: a chance agreement costs a
segment, not a wrong result, because strings are compared by their bytes.

Defined results: null and empty texts have no bytes; texts under SPAN bytes keep all; a null doc_id counts as greater than any
other; rows with equal doc_ids do not remove from one another; an empty table gives no rows; very long texts make large blocks;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.induced_sort import suffixes_descending

SPAN, GRAM, BLOCK_BYTES, SHARD_BYTES, MEMORY, PER_BUCKET = 50, 24, 3 << 20, 5 << 20, 48 << 20, 400_000
TELL = 64  # windows under an anchor in a block from which the block tells how many; fewer count as so many
NO_ID = (1 << 63) - 1
CUT = 0xFF  # never a byte of UTF-8
BLOCK = "block long, n_anchors long, doc_ids binary, lengths binary, data binary"


TEXT_LEVEL = 5  # of compression, for texts: they are written and shuffled several times


def _pack(data, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data if isinstance(data, bytes) else data.tobytes())


def _unpack(data: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _power(n: int, base: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


BASES = int(common._BASE), 0xD6E8FEB86659FD93


def byte_grams(text: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """Hashes of all k-byte substrings, by doubling."""
    if len(text) < k:
        return np.empty(0, np.uint64)
    part, size, out, done = text.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            if out is None:
                out = part.copy()
            else:
                m = min(len(out), len(part) - done)
                out = out[:m] * _power(size, base) + part[done : done + m]
            done += size
        if 2 * size > k:
            out = out[: len(text) - k + 1]
            out ^= out >> np.uint64(32)
            out *= np.uint64(0x94D049BB133111EB)  # the upper bits are the well-mixed ones
            return out
        m = len(part) - size
        part = part[:m] * _power(size, base) + part[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


class Text:
    """A block's documents, joined with a byte that no text has, and the anchors of their windows."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, ids: np.ndarray):
        self.data, self.lengths, self.ids = data, lengths, ids
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor of each window start (48 bits), and whether a window lies within one document."""
        n = len(self.data) - SPAN + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        least, step = np.empty(n, np.uint64), 1 << 15  # pieces that stay in the processor's cache
        for i in range(0, n, step):
            piece = byte_grams(self.data[i : i + step + SPAN - 1], GRAM)
            least[i : i + step] = sliding_min(piece >> np.uint64(16), SPAN - GRAM + 1)
        inside = np.ones(n, bool)
        ends = self.starts + self.lengths  # the windows from SPAN - 1 bytes before a text's end up to its cut are in no text
        for k in range(SPAN):
            at = ends - k
            inside[at[(at >= 0) & (at < n)]] = False
        return least, inside

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    names, kinds = ["block", "n_anchors", "doc_ids", "lengths", "data"], [pa.int64(), pa.int64()] + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            lengths = np.array([len(t) for t in texts], np.int64)
            row = number, int(lengths.sum()), np.array(ids, np.int64).tobytes(), lengths.tobytes(), _pack(b"".join(t + b"\xff" for t in texts), TEXT_LEVEL)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(NO_ID if i is None else i)
                    texts.append((t or "").encode("utf-8", "replace"))
                    size += len(texts[-1])
                    if size >= block_bytes:
                        yield flush()
                        number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, BLOCK)


def _bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor >> np.uint64(16)).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)


def _text(row) -> Text:
    return Text(_unpack(row["data"]), np.frombuffer(row["lengths"], np.int64), np.frombuffer(row["doc_ids"], np.int64))


def _six(a: np.ndarray) -> bytes:
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _of_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _ends(text: Text, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last window of each run that starts at `at`: before the next run or at the end of the document; and the document."""
    doc = text.documents(at)
    if not len(at):
        return at, doc
    return np.minimum(np.append(at[1:], len(text.data)) - 1, (text.starts + text.lengths - SPAN)[doc]), doc


def _shared_anchors(blocks: DataFrame, buckets: int, hot_windows: int) -> DataFrame:
    """(block, bucket, bits, n, hot, hot_windows): which of the block's n sorted distinct anchors in the bucket are those of several
    documents, and the places of those with more than hot_windows windows in all blocks; one row of a bucket has their windows."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                t = _text(row)
                anchor, inside = t.anchors()
                new = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]]) if len(anchor) else inside
                at = np.flatnonzero(new)
                end, d = _ends(t, at)
                a, order = anchor[at], np.lexsort((d, anchor[at]))
                a, d, windows = a[order], d[order], (end - at + 1)[order]
                first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.empty(0, bool)
                many = np.zeros(len(a), bool)
                if len(a) > 1:  # another document under the same anchor, within the block
                    many[1:] = ~first[1:] & (d[1:] != d[:-1])
                begin = np.flatnonzero(first)
                several = np.logical_or.reduceat(many, begin) if len(begin) else np.empty(0, bool)
                windows = np.add.reduceat(windows, begin) if len(begin) else windows
                a = a[first]
                bucket = _bucket_of(a, buckets).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(a) else np.array([0])
                rows = []
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    big = np.flatnonzero(windows[i:j] > TELL)
                    rows.append((int(bucket[i]), row["block"], _six(a[i:j]), np.packbits(several[i:j]).tobytes(), big.astype(np.uint32).tobytes(), windows[i:j][big].astype(np.int64).tobytes()))
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "block", "anchors", "several", "big", "windows"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [_of_six(a) for a in pdf["anchors"]]
        flags = [np.unpackbits(np.frombuffer(s, np.uint8))[: len(a)].astype(bool) for a, s in zip(asked, pdf["several"], strict=True)]
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        s = every[order]
        same = s[1:] == s[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        # An anchor that one block holds for several documents counts for all blocks: they hold it as well, so it is there twice.
        shared = np.empty(len(every), bool)
        shared[order] = twice
        shared |= np.concatenate(flags)
        # An upper bound of each anchor's windows: what blocks tell, and TELL for each block that tells nothing.
        windows = np.full(len(every), TELL, np.int64)
        at = 0
        for a, big, n in zip(asked, pdf["big"], pdf["windows"], strict=True):
            windows[at + np.frombuffer(big, np.uint32).astype(np.int64)] = np.frombuffer(n, np.int64)
            at += len(a)
        begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(s) else np.empty(0, np.int64)
        total = np.add.reduceat(windows[order], begin) if len(begin) else windows
        heat = total > hot_windows
        hot = np.empty(len(every), bool)
        hot[order] = np.repeat(heat, np.diff(np.append(begin, len(s))))
        hot &= shared
        out, at, whole = [], 0, int(windows[hot].sum())
        for number, a in zip(pdf["block"], asked, strict=True):
            mine = slice(at, at + len(a))
            out.append((int(number), int(key[0]), np.packbits(shared[mine]).tobytes(), len(a), np.flatnonzero(hot[mine]).astype(np.uint32).tobytes(), 0 if at else whole))
            at += len(a)
        return pd.DataFrame(out, columns=["block", "bucket", "bits", "n", "hot", "hot_windows"])

    asked = blocks.select("block", "doc_ids", "lengths", "data").mapInArrow(ask, "bucket long, block long, anchors binary, several binary, big binary, windows binary")
    return asked.groupBy("bucket").applyInPandas(answer, "block long, bucket long, bits binary, n long, hot binary, hot_windows long")


class Segments:
    """The runs of a block's windows under one shared anchor, under a hot one each window; equal ones once, in the order of their first place."""

    def __init__(self, text: Text, bits: list[tuple[bytes, int, bytes]]):
        anchor, inside = text.anchors()
        new = inside & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~inside[:-1]]) if len(anchor) else inside
        at = np.flatnonzero(new)
        distinct, back = np.unique(anchor[at], return_inverse=True)
        shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n, _ in bits]).astype(bool) if bits else np.zeros(0, bool)
        assert len(shared) == len(distinct)
        heat, first = np.zeros(len(distinct), bool), 0
        for _, n, places in bits:
            heat[first + np.frombuffer(places, np.uint32).astype(np.int64)] = True
            first += n
        end, doc = _ends(text, at)
        keep = shared[back] if len(at) else np.zeros(0, bool)
        at, n, anchor, hot, ids = at[keep], (end - at + 1)[keep], anchor[at[keep]], heat[back][keep] if len(at) else keep, text.ids[doc[keep]]
        known: dict[bytes, int] = {}
        data, cold = text.data.tobytes(), ~hot
        of = np.fromiter((known.setdefault(data[a : a + w + SPAN - 1], len(known)) for a, w in zip(at[cold].tolist(), n[cold].tolist(), strict=True)), np.int64, int(cold.sum()))
        self.texts, self.data = list(known), text.data
        # Windows under hot anchors are one by one, so they stay in arrays; 128 bits of hash tell them apart within the block.
        m = n[hot]
        single = np.repeat(at[hot], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        one, two = (byte_grams(text.data, SPAN, base)[single] for base in BASES) if len(single) else (np.empty(0, np.uint64),) * 2
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        of_single = np.empty(len(order), np.int64)
        of_single[order] = np.cumsum(new) - 1
        # No window of a cold anchor's run equals a window under a hot one: its bytes decide its anchor, and heat is of all blocks.
        self.at, self.windows = np.concatenate([at[cold], single]), np.concatenate([n[cold], np.ones(len(single), np.int64)])
        self.of, self.ids = np.concatenate([of, of_single + len(known)]), np.concatenate([ids[cold], np.repeat(ids[hot], m)])
        self.first = single[order[new]]
        self.n = len(known) + len(self.first)
        self.hot = np.arange(self.n) >= len(known)
        self.least = np.full(self.n, NO_ID, np.int64)
        np.minimum.at(self.least, self.of, self.ids)
        self.key = np.zeros(self.n, np.uint64)
        self.key[of] = anchor[cold]
        self.key[len(known) :] = (one ^ common.mix(two))[order[new]]

    def bytes_of(self, k: int) -> bytes:
        if k < len(self.texts):
            return self.texts[k]
        a = self.first[k - len(self.texts)]
        return self.data[a : a + SPAN].tobytes()


def _ask_segments(blocks: DataFrame, shared: DataFrame, shards: int, hot_shards: int) -> DataFrame:
    """Each block's segments by shard; windows under hot anchors go to the hot_shards that follow the others."""

    def run(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("bucket")
        s = Segments(_text(own.iloc[0]), list(zip(told["bits"], told["n"], told["hot"], strict=True)))
        key_ = common.mix(s.key)
        shard = np.where(s.hot, shards + (key_ % np.uint64(hot_shards)).astype(np.int64), (key_ % np.uint64(shards)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        rows, sorted_shard = [], shard[order]
        cut = np.flatnonzero(np.concatenate([[True], sorted_shard[1:] != sorted_shard[:-1], [True]])) if len(order) else np.array([0])
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            mine = order[i:j]
            texts = list(map(s.bytes_of, mine.tolist()))
            rows.append((int(sorted_shard[i]), int(key[0]), mine.astype(np.int64).tobytes(), _pack(np.array([len(t) for t in texts], np.int64)), s.least[mine].tobytes(), _pack(b"".join(texts), TEXT_LEVEL)))
        return pd.DataFrame(rows, columns=["shard", "block", "segment", "sizes", "least", "data"]).astype({"shard": "int64", "block": "int64"})

    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(run, "shard long, block long, segment binary, sizes binary, least binary, data binary")


def least_ids(texts: list[bytes], least: np.ndarray, spill: str | None = None, memory: int = MEMORY) -> np.ndarray:
    """For each window (texts in turn, each len - SPAN + 1 windows), the least id of any text that holds its SPAN bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = sizes - SPAN + 1
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    first = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(texts), dtype=np.int32), sizes + 1)
    out = np.empty(int(windows.sum()), np.int64)
    place, lcp, run = [], [], SPAN + 6
    held = 0

    def settle(place: np.ndarray, joined: np.ndarray) -> None:
        begin = np.flatnonzero(~joined)
        own = of[place]
        low = np.minimum.reduceat(least[own], begin)
        out[first[own] + place - starts[own]] = np.repeat(low, np.diff(np.append(begin, len(place))))

    # Suffixes come in descending order; those that do not begin a window only pass their common prefix on.
    for at, up in suffixes_descending(data, spill, memory):
        own = of[at]
        valid = np.flatnonzero(at - starts[own] < windows[own])
        up = up.astype(np.int64)
        if not len(valid):
            run = min(run, int(up.min()))
            continue
        lo = np.empty(len(valid), np.int64)
        lo[0] = min(run, int(up[: valid[0] + 1].min()))
        if len(valid) > 1:
            lo[1:] = np.minimum.reduceat(up[1 : valid[-1] + 1], valid[:-1])
        rest = up[valid[-1] + 1 :]
        run = int(rest.min()) if len(rest) else SPAN + 6
        place.append(at[valid])
        lcp.append(lo >= SPAN)
        held += len(valid)
        if held > 1 << 20:
            p, j = np.concatenate(place), np.concatenate(lcp)
            stop = np.flatnonzero(~j)
            if len(stop) > 1:  # the last group may go on
                settle(p[: stop[-1]], np.concatenate([[False], j[1 : stop[-1]]]))
                p, j = p[stop[-1] :], j[stop[-1] :]
            place, lcp, held = [p], [j], len(p)
    if place:
        p, j = np.concatenate(place), np.concatenate(lcp)
        j[0] = False
        settle(p, j)
    return out


def _first_anchors(texts: list[bytes], step: int = 4096) -> np.ndarray:
    """The anchor of each text's first window; a few thousand texts at a time."""
    out = []
    for i in range(0, len(texts), step):
        part = b"".join(t[:SPAN] for t in texts[i : i + step])
        least = sliding_min(byte_grams(np.frombuffer(part, np.uint8), GRAM) >> np.uint64(16), SPAN - GRAM + 1)
        out.append(least[::SPAN])
    return np.concatenate(out)


def _answers(asked: DataFrame, spill: str) -> DataFrame:
    """For each block's segments, the least ids of their windows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        least, where = [], []
        for sizes, low, data in zip(pdf["sizes"], pdf["least"], pdf["data"], strict=True):
            data, mine, at = _unpack(data).tobytes(), [], 0
            for n, i in zip(_unpack(sizes, np.int64).tolist(), np.frombuffer(low, np.int64).tolist(), strict=True):
                k = known.setdefault(data[at : at + n], len(known))
                at += n
                if k == len(least):
                    least.append(i)
                elif i < least[k]:
                    least[k] = i
                mine.append(k)
            where.append(np.array(mine, np.int64))
        texts, least = list(known), np.array(least, np.int64)
        windows = np.array([len(t) - SPAN + 1 for t in texts], np.int64)
        first = np.cumsum(windows) - windows
        result = np.repeat(least, windows)
        # Equal windows have one anchor: a segment that is alone under its anchor has its answer, and so have distinct single
        # windows; the others are sorted.
        several = np.zeros(len(texts), bool)
        if (windows > 1).any():
            _, of, n = np.unique(_first_anchors(texts), return_inverse=True, return_counts=True)
            longer = np.bincount(of, weights=windows > 1, minlength=len(n)) > 0
            several = (n[of] > 1) & longer[of]
        if several.any():
            result[np.repeat(several, windows)] = least_ids([t for t, s in zip(texts, several.tolist(), strict=True) if s], least[several], spill)
        rows = []
        for number, segment, mine in zip(pdf["block"], pdf["segment"], where, strict=True):
            values = np.concatenate([result[first[k] : first[k] + windows[k]] for k in mine.tolist()])
            rows.append((int(number), segment, _pack(values)))
        return pd.DataFrame(rows, columns=["block", "segment", "least"])

    return asked.groupBy("shard").applyInPandas(run, "block long, segment binary, least binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(blocks: DataFrame, shared: DataFrame, told: DataFrame, with_text: bool) -> DataFrame:
    # Both answers travel as rows of one table, so that the blocks are co-grouped once.
    both = shared.select("block", F.col("bucket").alias("ord"), F.col("bits").alias("a"), F.col("hot").alias("b"), "n").unionByName(
        told.select("block", F.lit(-1).cast("long").alias("ord"), F.col("segment").alias("a"), F.col("least").alias("b"), F.lit(0).cast("long").alias("n"))
    )

    def run(key: tuple, own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        text = _text(own.iloc[0])
        bits, found = rows[rows["ord"] >= 0].sort_values("ord"), rows[rows["ord"] < 0]
        s = Segments(text, list(zip(bits["a"], bits["n"], bits["b"], strict=True)))
        windows = np.zeros(s.n, np.int64)
        windows[s.of] = s.windows
        first = np.cumsum(windows) - windows
        least = np.full(int(windows.sum()), NO_ID, np.int64)
        for segment, values in zip(found["a"], found["b"], strict=True):
            values, at = _unpack(values, np.int64), 0
            for k in np.frombuffer(segment, np.int64).tolist():
                least[first[k] : first[k] + windows[k]] = values[at : at + windows[k]]
                at += windows[k]
        gone = np.zeros(len(text.data) + 1, np.int32)
        done = np.cumsum(s.windows)
        i = 0
        while i < len(s.at):  # about a million windows at a time
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + (1 << 20), "right")))
            n = s.windows[i:j]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = least[np.repeat(first[s.of[i:j]], n) + offset] < np.repeat(s.ids[i:j], n)
            start = (np.repeat(s.at[i:j], n) + offset)[hit]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + SPAN, -1)
            i = j
        gone = np.cumsum(gone[:-1]) > 0
        out = []
        for i, a, n in zip(text.ids.tolist(), text.starts.tolist(), text.lengths.tolist(), strict=True):
            g, own_data = gone[a : a + n], text.data[a : a + n]
            kept = own_data[~g].tobytes()
            spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(n > 0 and g[0])
            row = (None if i == NO_ID else i, n, int(np.count_nonzero(g)), spans, hashlib.sha256(kept).hexdigest())
            out.append(row + (kept,) if with_text else row)
        out = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(run, RESULT + ", kept binary" * with_text)


def dedup_spans(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with_text adds the remaining bytes as `kept`."""
    spark = docs.sparkSession
    least = common.parallelism(spark)
    blocks = common.materialise(_blocks(common.documents(docs), block_bytes), "byte-blocks", "none")
    size = blocks.agg(F.coalesce(F.sum("n_anchors"), F.lit(0))).first()[0]  # about one anchor for each 14 bytes
    shared = common.materialise(_shared_anchors(blocks, max(least, -(-size // 14 // PER_BUCKET)), shard_bytes // 8), "shared-anchors", "none")
    hot = shared.agg(F.coalesce(F.sum("hot_windows"), F.lit(0))).first()[0]
    asked = common.materialise(_ask_segments(blocks, shared, max(least, -(-size // shard_bytes)), max(1, -(-hot * SPAN // shard_bytes))), "segments", "none")
    told = common.materialise(_answers(asked, common.scratch(spark, "sort-spill")), "least-ids", "none")
    common.release(asked)
    return _finish(blocks, shared, told, with_text)
