"""Token-ID / binary output: one array of ids per shard, with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by doc_id; each partition streams its ids to one file in the shared folder and
closes it with the boundaries in Elias-Fano form, and with the doc_ids, which ascend as well, in another such sequence. n values up
to u take n * (2 + log2(u / n)) bits. select() finds the i-th by a binary search over sampled counts of ones and a popcount within
512 bits; selects() does so for a run of neighbours, BLOCK values at a time. All reading goes through them: no table of 64-bit
offsets exists on disk or in memory.

A shard is about SHARD_BYTES of text, whatever the size of the table. Defined results: a null or empty text is a document of one
token, the end id; a null doc_id sorts first; repeated rows are written once each; an empty table gives no shard and no rows; very
long texts are encoded whole, and a shard may then be larger; other columns are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

MAGIC = b"QTOK\x02\x00\x00\x00"
END_ID = 1
SHARD_BYTES = 256 << 20


class EliasFano:
    """A non-decreasing sequence of n integers from 0 to u in about n * (2 + log2(u / n)) bits, with random access."""

    BLOCK = 512

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        pad = -len(high) % (self.BLOCK // 8)
        bits = np.concatenate([high, np.zeros(pad, np.uint8)]) if pad else high
        per = np.bitwise_count(bits).reshape(-1, self.BLOCK // 8).sum(1, dtype=np.uint32) if len(bits) else np.zeros(0, np.uint32)
        self._before = np.concatenate([[0], np.cumsum(per, dtype=np.uint32)])  # ones before each block

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, u = len(v), int(v[-1]) + 1 if len(v) else 1
        width = max(0, (u // max(1, n)).bit_length() - 1)
        low = np.zeros(-(-n * width // 8), np.uint8)
        high = np.zeros(((int(v[-1]) >> width) + n - 1) // 8 + 1 if n else 0, np.uint8)
        for i in range(0, n, 1 << 16):  # so many at a time; a multiple of eight, so each begins at a whole byte
            part = v[i : i + (1 << 16)]
            if width:
                bits = ((part[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits.ravel(), bitorder="little")
                low[i * width // 8 : i * width // 8 + len(packed)] = packed
            at = (part >> np.uint64(width)).astype(np.int64) + np.arange(i, i + len(part))
            np.bitwise_or.at(high, at // 8, (1 << (at % 8)).astype(np.uint8))
        return cls(n, width, low, high)

    def select(self, i: int) -> int:
        """The i-th value: the position of the i-th one among the high bits, less i, joined to its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block = int(np.searchsorted(self._before, i, side="right")) - 1
        rest = i - int(self._before[block])
        part = np.unpackbits(self.high[block * self.BLOCK // 8 : (block + 1) * self.BLOCK // 8], bitorder="little")
        at = block * self.BLOCK + int(np.flatnonzero(part)[rest])
        value = (at - i) << self.width
        if self.width:
            first = i * self.width
            bits = np.unpackbits(self.low[first // 8 : (first + self.width) // 8 + 1], bitorder="little")[first % 8 : first % 8 + self.width]
            value |= int((bits.astype(np.int64) << np.arange(self.width)).sum())
        return value

    def selects(self, i: int, j: int) -> np.ndarray:
        """The values from the i-th up to, but without, the j-th; both within n."""
        if i >= j:
            return np.empty(0, np.int64)
        block = int(np.searchsorted(self._before, i, side="right")) - 1
        to = int(np.searchsorted(self._before, j - 1, side="right"))
        part = np.unpackbits(self.high[block * self.BLOCK // 8 : to * self.BLOCK // 8], bitorder="little")
        skip = i - int(self._before[block])
        at = block * self.BLOCK + np.flatnonzero(part)[skip : skip + j - i]
        out = (at - np.arange(i, j)) << self.width
        if self.width:
            first = i * self.width
            bits = np.unpackbits(self.low[first // 8 : (j * self.width + 7) // 8], bitorder="little")[first % 8 : first % 8 + (j - i) * self.width]
            out |= (bits.reshape(j - i, self.width).astype(np.int64) << np.arange(self.width)).sum(1)
        return out

    def __iter__(self) -> Iterator[int]:
        for i in range(0, self.n, self.BLOCK):
            yield from self.selects(i, min(self.n, i + self.BLOCK)).tolist()

    def tobytes(self) -> bytes:
        return struct.pack("<QIQQ", self.n, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, width, a, b = struct.unpack_from("<QIQQ", data)
        k = struct.calcsize("<QIQQ")
        return cls(n, width, np.frombuffer(data, np.uint8, a, k), np.frombuffer(data, np.uint8, b, k + a))


#: A comma or full stop between a letter and white space is a piece of its own.
_STOP = re.compile(r"(?<=[a-z])([,.])(?=[ \n]|$)")


class WordEncoder:
    """Encodes by white-space-separated words and remembers each word's ids.

    The vocabulary's pre-tokeniser drops white space and no piece spans it, so the ids of a text are those of its words in
    turn. New words go through the library; the memory is emptied at `limit` words.
    """

    def __init__(self, path: str, dtype=np.uint16, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tok, self.dtype, self.limit = Tokenizer.from_file(path), dtype, limit
        self.tok.no_padding()
        self.tok.no_truncation()
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.lowers = "Lowercase" in json.dumps(d["normalizer"])
        suffix, vocab = d["model"].get("end_of_word_suffix"), self.tok.get_vocab()
        # Letters alone make one piece; where pieces end with a mark, the ids of many words in one line can be told apart.
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(words)
        plain = [w for w in new if w.isalpha()] if self.ends is not None else []
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        rest = [w for w in new if not w.isalpha()] if self.ends is not None else new
        for part, e in zip(lines, self.tok.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):  # some word is of several pieces after all
                rest += part
                continue
            data, size, at = ids.tobytes(), ids.itemsize, 0
            for w, to in zip(part, stops.tolist(), strict=True):
                self.known[w] = data[at * size : to * size]
                at = to
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def _words(self, text: str | None) -> list[str]:
        """Words with the same ids in the same order, as few different ones as is cheap: A-Z lowered, a last comma or stop apart."""
        if text and self.lowers and "<|" not in text:
            text = _STOP.sub(r" \1", common.lower_ascii(text))
        return common.words_of(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes of dtype."""
        for i in range(0, len(texts), 1024):
            split = [self._words(t) for t in texts[i : i + 1024]]
            self.learn(set().union(*split))
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))


_ENCODERS: dict = {}


def encoder(path: str, dtype) -> WordEncoder:
    key = (path, np.dtype(dtype).str)
    if key not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = WordEncoder(path, dtype)
    return _ENCODERS[key]


def vocabulary_width(path: str) -> int:
    """Bytes an id: 2 where all ids, the end id included, fit in 16 bits."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    most = max([END_ID, *d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens", []))])
    return 2 if most < 1 << 16 else 4


class ShardWriter:
    """Streams the ids of one shard to a file; only the documents' lengths and ids stay in memory until close()."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.final = f"{self.root}/{name}"
        self.part = f"{self.root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.width, self.ends, self.ids, self.nulls = self.fs.open_output_stream(self.part), width, array("q"), array("q"), 0
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, data: bytes) -> None:
        """Documents come in ascending order of doc_id, those without one first."""
        self.out.write(data)
        self.ends.append((self.ends[-1] if self.ends else 0) + len(data) // self.width)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[int, int]:
        least, n = self.ids[0] if self.ids else 0, len(self.ends)
        ends = EliasFano.encode(np.frombuffer(self.ends, np.int64)).tobytes()
        ids = EliasFano.encode(np.frombuffer(self.ids, np.int64).astype(np.uint64) - np.uint64(least & (1 << 64) - 1)).tobytes()  # distances wrap as two's complements do
        self.out.write(ends + ids + struct.pack("<QQQqQQI", len(ends), len(ids), n, least, self.nulls, self.ends[-1], self.width))
        self.out.close()
        self.fs.move(self.part, self.final)  # a repeated task puts the same bytes in the same place
        return n, self.ends[-1]


class ShardReader:
    """Random access to one shard's documents; boundaries and doc_ids come from Elias-Fano selects."""

    TAIL = struct.calcsize("<QQQqQQI")

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(self.path)
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        size = self.file.size()
        n_ends, n_ids, self.n_docs, self.least, self.nulls, self.n_tokens, self.width = struct.unpack("<QQQqQQI", self.file.read_at(self.TAIL, size - self.TAIL))
        at = size - self.TAIL - n_ids - n_ends
        self.ends = EliasFano.frombytes(self.file.read_at(n_ends, at))
        self.ids = EliasFano.frombytes(self.file.read_at(n_ids, at + n_ends))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.ids.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the shard."""
        lo = self.ends.select(i - 1) if i else 0
        return self._ids(lo, self.ends.select(i))

    def _ids(self, lo: int, hi: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((hi - lo) * self.width, len(MAGIC) + lo * self.width), f"<u{self.width}")

    def scan(self, step: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first token in the shard, ids) of each document; selects a block of boundaries and reads about `step` tokens at a time."""
        n, at, lo = EliasFano.BLOCK, 0, 0
        ids = iter(self.ids)
        while at < self.n_docs:
            ends = self.ends.selects(at, min(self.n_docs, at + n))
            first = 0
            while first < len(ends):
                to = max(first + 1, int(np.searchsorted(ends, lo + step, side="right")))
                data, begin = self._ids(lo, int(ends[to - 1])), lo
                for end in ends[first:to].tolist():
                    yield None if at < self.nulls else self.least + (next(ids) & (1 << 64) - 1), lo, data[lo - begin : end - begin]
                    at, lo = at + 1, end
                first = to


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, shards: int | None = None) -> tuple[str, list[dict]]:
    """Writes the documents' ids as shards in ascending doc_id order. Returns the folder and one entry for each shard.

    `tokenizer` is the path of a vocabulary file that all machines have. Shards are deterministic files: a task that runs
    again overwrites its own with the same bytes. The driver sees three numbers a shard.
    """
    spark = docs.sparkSession
    folder = folder or common.scratch(spark, "tokens")
    width = vocabulary_width(tokenizer)
    end = np.array([END_ID], f"<u{width}").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, out, enc = TaskContext.get().partitionId(), None, encoder(tokenizer, f"<u{width}")
        for b in batches:
            if b.num_rows and out is None:
                out = ShardWriter(folder, f"shard-{k:06d}.qtok", width)
            for i, data in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                out.add(i, data + end)
        if out is not None:
            n_docs, n_tokens = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["shard", "n_docs", "n_tokens"])

    if not shards:
        size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = max(common.parallelism(spark), -(-size // SHARD_BYTES))
    n = shards
    rows = common.documents(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(write, "shard int, n_docs long, n_tokens long").collect()
    start, entries = 0, []
    for r in sorted(rows, key=lambda r: r.shard):
        entries.append({"path": f"{folder}/shard-{r.shard:06d}.qtok", "shard": r.shard, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "start": start})
        start += r.n_tokens
    return folder, entries


def read_tokens(spark, entries: list[dict]) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids_crc32 and ids of each document, read from the shards."""
    return _read(spark, entries, True)


def token_digests(spark, entries: list[dict]) -> DataFrame:
    """As read_tokens, without the ids themselves."""
    return _read(spark, entries, False)


def _read(spark, entries: list[dict], with_ids: bool) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for doc_id, at, ids in ShardReader(path).scan():
                    rows.append((doc_id, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                    held += len(ids) if with_ids else 1
                    if held > 500_000:
                        yield _batch(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, with_ids)

    shards = spark.createDataFrame([(e["path"], e["start"]) for e in entries], "path string, start long")
    return shards.repartition(max(1, min(len(entries), 4096))).mapInArrow(read, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
