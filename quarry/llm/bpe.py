"""BPE encoding and decoding with a byte-level vocabulary, by batched numpy merge rounds.

The symbols of many new words lie in one flat array. A round looks all neighbouring pairs up by binary search over the sorted
pair keys, finds each word's lowest rank, merges that pair wherever the word has it, and drops words without pairs. A worker
remembers the ids of words, so frequent words are merged once; the memory is emptied at a fixed number of words.

Defined results: a null or empty text has no ids and decodes to an empty text; very long words (and texts without white space)
are merged whole; repeated rows are encoded each; an empty table gives no rows; other columns pass through encode_column
untouched and are not read by encode_digests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import common

#: How the byte-level vocabularies split text before merges (published with them).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files, as character -> byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """One vocabulary with its merges; encodes and decodes."""

    def __init__(self, path: str, limit: int = 600_000):
        import regex

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab, merges, self.limit = d["model"]["vocab"], d["model"]["merges"], limit
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.pieces[i] = bytes(alphabet[c] for c in s)
        for s, i in self.special.items():
            self.pieces[i] = s.encode()
        self.texts = [str(i) for i in range(size)]
        self.first = np.zeros(256, np.int64)  # each byte's own id
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        keep = np.concatenate([[True], np.diff(keys[order]) != 0]) if len(order) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][keep], order[keep].astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.find = regex.compile(SPLIT).findall
        names = sorted(self.special, key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.known: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by rounds over all words at once."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        none = len(self.ranks) + 1
        while len(ids):
            same = word[1:] == word[:-1]
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = same & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)
            rank = np.where(hit, self.ranks[at] if len(self.keys) else 0, none)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.concatenate([rank, [none]]), starts)  # the last pair of a word crosses into the next: none
            spans = np.diff(np.concatenate([starts, [len(ids)]]))
            done = np.repeat(lowest == none, spans)
            if done.any():
                for s, n in zip(starts[lowest == none], spans[lowest == none], strict=True):
                    out[word[s]] = ids[s : s + n]
                if done.all():
                    break
            chosen = np.zeros(len(ids), bool)
            chosen[:-1] = (rank == np.repeat(lowest, spans)[:-1]) & (rank < none)
            # In a run of overlapping hits (one symbol repeated) every second one from the left merges.
            run_start = chosen & ~np.concatenate([[False], chosen[:-1]])
            where = np.arange(len(ids))
            begun = np.maximum.accumulate(np.where(run_start, where, -1))
            chosen &= (where - begun) % 2 == 0
            ids[chosen] = self.merged[rank[np.flatnonzero(chosen)]]
            gone = np.concatenate([[False], chosen[:-1]])
            keep = ~gone & ~done
            ids, word = ids[keep], word[keep]
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for w, ids in zip(part, self.merge([w.encode("utf-8", "replace") for w in part]), strict=True):
                self.known[w] = ids.astype("<u4").tobytes()

    def _parts(self, text: str) -> list[list[str] | int]:
        if self.at_special and any(s in text for s in self.special):
            return [self.special[p] if p in self.special else self.find(p) for p in self.at_special(text) if p]
        return [self.find(text)]

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become those tokens, as the library has it."""
        for i in range(0, len(texts), 64):
            split = [self._parts(t) if t else [] for t in texts[i : i + 64]]
            self.learn({w for parts in split for p in parts if not isinstance(p, int) for w in p})
            for parts in split:
                yield np.frombuffer(b"".join(p.to_bytes(4, "little") if isinstance(p, int) else b"".join(map(self.known.__getitem__, p)) for p in parts), "<u4")

    def decode(self, ids) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


_KNOWN: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    if path not in _KNOWN:
        _KNOWN[path] = ByteBPE(path)
    return _KNOWN[path]


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; the decoded text comes from the ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                n, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_batch(part.column(1).to_pylist()):
                    ids = ids.tolist()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(bpe.texts.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of ids beside all its own columns."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def ids(texts):
        import pandas as pd

        return pd.Series([x.astype(np.int32) for x in load(vocabulary).encode_batch([t if isinstance(t, str) else None for t in texts])], dtype=object)

    return docs.withColumn(out, ids(docs[text]))


def decode_column(rows: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the text of a column of ids; null ids decode to an empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(col):
        import pandas as pd

        return pd.Series([load(vocabulary).decode([] if x is None else list(x)) for x in col], dtype=object)

    return rows.withColumn(out, text(rows[ids]))
