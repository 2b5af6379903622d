"""LM scoring with Brown class-based n-grams.

P(w | before) = P(class of w | class of before) * P(w | class of w). Every training word is assigned to its class by exchange
clustering: a word moves to the class that raises the likelihood of the class bigrams most. It runs in two steps:

1. the SEEDS most frequent words (by their whole counts) are exchanged one by one on their own bigram counts until none moves,
   and every other word joins the class under which its left and right neighbours are likeliest;
2. up to SWEEPS exchange sweeps over the whole vocabulary follow, seeds included. In a sweep each hash bucket takes each of its
   words out of its class and puts it where the exact gain over the class bigrams of the sweep's beginning is greatest. All moves
   of a sweep happen at once; one that lowers the likelihood is undone and ends the clustering.

Unknown words share the Good-Turing mass of words seen once.

No table of all words is ever in one place. Documents become blocks of about BLOCK_TOKENS tokens, each with a sorted dictionary
of word hashes; a block asks the hash buckets for the counts and classes of its own words, and the answers come back aligned with
the dictionary. What is broadcast (SEEDS words, CLASSES ** 2 counts) has a fixed size, and what is gathered grows with the corpus.

Words are compared by 64-bit hash. Defined results: null and empty texts are their end token; a null doc_id is held out or not by
the crc32 of an empty text; repeated rows count and are scored each; words that are equally frequent are ordered by hash, and of
equally good classes the lowest is taken; without training rows every probability is that of the base model; an empty table gives
no rows; very long texts make large blocks; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

SEEDS, CLASSES, BLOCK_TOKENS, PER_BUCKET, SMOOTH, SWEEPS = 512, 24, 800_000, 200_000, 5.0, 1
END_CLASS, UNKNOWN, OTHER = CLASSES, CLASSES + 1, CLASSES + 1  # the last two: of an answer, of a context
WIDTH = CLASSES + 2
END = np.uint64(0x454E44)
_NONE = -(1 << 63)
BLOCK = "block long, n_words long, train_docs long, train_tokens long, doc_ids binary, held binary, lengths binary, tokens binary, words binary, counts binary"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _pack_ids(a: np.ndarray) -> bytes:
    """Small numbers most of the time: bytes of equal weight lie together, so they compress near to their entropy."""
    return zstandard.ZstdCompressor(level=3).compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack_ascending(a: np.ndarray) -> bytes:
    return _pack_ids(np.diff(a, prepend=0))


def _unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_ids(data).astype(np.int64))


def _by_frequency(counts: np.ndarray) -> np.ndarray:
    """Places of a block's dictionary, the words most frequent in training first: tokens are stored by this rank."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def held_out(doc_id) -> bool:
    return common.crc_of_id(doc_id) % 7 == 2


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the words and the end token."""
    h = common.word_hashes(common.words_of(common.lower_ascii(text))) if text else np.empty(0, np.uint64)
    return np.append(h, END)


def _block(number: int, ids: list, held: list, parts: list[np.ndarray]) -> dict:
    lengths = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts)
    words, local = np.unique(flat, return_inverse=True)
    train = np.repeat(~np.array(held, bool), lengths)
    counts = np.bincount(local[train], minlength=len(words))
    rank = np.empty(len(words), np.int64)
    rank[_by_frequency(counts)] = np.arange(len(words))
    return {
        "block": number, "n_words": len(words), "train_docs": int((~np.array(held, bool)).sum()), "train_tokens": int(train.sum()), "doc_ids": np.array(ids, np.int64).tobytes(),
        "held": np.array(held, np.uint8).tobytes(), "lengths": lengths.tobytes(), "tokens": _pack_ids(rank[local]), "words": words.tobytes(), "counts": _pack_ids(counts),
    }


_KINDS = [pa.int64()] * 4 + [pa.binary()] * 6
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, held, parts, size = TaskContext.get().partitionId() << 32, [], [], [], 0

        def flush():
            row = _block(number, ids, held, parts)
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)

        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = tokens_of(text)
                    ids.append(_NONE if i is None else i)
                    held.append(held_out(i))
                    parts.append(t)
                    size += len(t)
                    if size >= block_tokens:
                        yield flush()
                        number, ids, held, parts, size = number + 1, [], [], [], 0
        if parts:
            yield flush()

    return docs.mapInArrow(common.emptied(run), BLOCK)


class Block:
    """One row of the block table, unpacked."""

    def __init__(self, words: bytes, counts: bytes, tokens: bytes, lengths: bytes, held: bytes):
        self.words, self.counts = np.frombuffer(words, np.uint64), _unpack_ids(counts)
        self.tokens, self.lengths = _by_frequency(self.counts)[_unpack_ids(tokens)], np.frombuffer(lengths, np.int64)
        self.train = np.repeat(np.frombuffer(held, np.uint8) == 0, self.lengths)

    def labels(self, seeds: np.ndarray, of_seed: np.ndarray, other: int, end: int) -> np.ndarray:
        """For each word of the dictionary: of_seed of a seed, `end` of the end token, else `other`."""
        out = np.full(len(self.words), other, np.int64)
        if len(seeds):
            at = np.minimum(np.searchsorted(seeds, self.words), len(seeds) - 1)
            hit = seeds[at] == self.words
            out[hit] = of_seed[at[hit]]
        out[self.words == END] = end
        return out

    def pairs(self, label: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Labels of each token's predecessor (a document begins after an end token) and of the token itself."""
        own = label[self.tokens]
        return np.concatenate([[end], own[:-1]]), own


_USED = ["words", "counts", "tokens", "lengths", "held"]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)) for c in _USED), strict=True):
            yield Block(*(x.as_py() for x in row))


def _cuts(b: Block, buckets: int) -> np.ndarray:
    """Where the dictionary's words of each bucket begin: words and buckets have one order."""
    bucket = _bucket_of(b.words, buckets)
    return np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))


def _bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _seeds(blocks: DataFrame, buckets: int) -> np.ndarray:
    """The SEEDS most frequent training words, sorted by hash. Each bucket sums whole counts and sends its own best."""

    def ask(batches):
        for b in _each(batches):
            cut, rows = _cuts(b, buckets), [[], [], []]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                live = i + np.flatnonzero((b.counts[i:j] > 0) & (b.words[i:j] != END))
                for col, v in zip(rows, (int(_bucket_of(b.words[i : i + 1], buckets)[0]), b.words[live].tobytes(), b.counts[live].tobytes()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "words", "counts"])

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        words, at = np.unique(np.frombuffer(b"".join(pdf["words"]), np.uint64), return_inverse=True)
        n = np.bincount(at, weights=np.frombuffer(b"".join(pdf["counts"]), np.uint32), minlength=len(words)).astype(np.int64)
        top = np.lexsort((words, -n))[:SEEDS]
        return pd.DataFrame({"word": words[top].view(np.int64), "n": n[top]})

    asked = blocks.select(*_USED).mapInArrow(ask, "bucket long, words binary, counts binary")
    rows = asked.groupBy("bucket").applyInPandas(best, "word long, n long").orderBy(F.desc("n"), "word").limit(SEEDS).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _seed_bigrams(blocks: DataFrame, seeds: np.ndarray) -> np.ndarray:
    """Counts of pairs of seeds; two more labels stand for all other words and the end token."""
    n, sc = len(seeds) + 2, blocks.sparkSession.sparkContext
    shared = sc.broadcast(seeds)

    def run(batches):
        total = np.zeros(n * n, np.int64)
        for b in _each(batches):
            before, own = b.pairs(b.labels(shared.value, np.arange(len(shared.value)), n - 2, n - 1), n - 1)
            total += np.bincount((before * n + own)[b.train], minlength=n * n)
        yield from common.parts_of_sum(total)

    return common.summed(blocks.select(*_USED).mapInArrow(run, common.PARTS), n * n).reshape(n, n)


def _f(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word by exchange clustering; the last two rows of bigrams (other words, the end) keep classes of their own.

    A sweep takes each word out of its class and puts it where the sum of n log n over class bigrams, less those over the classes'
    left and right counts, is greatest. A word moves only for a gain, so the likelihood grows with every move, and sweeps go on until
    none moves.
    """
    b = bigrams.astype(np.float64)
    words = len(b) - 2
    order = np.argsort(-b[:words].sum(1), kind="stable")
    of = np.empty(len(b), np.int64)
    of[order] = np.arange(words) % classes
    of[words:] = classes, classes + 1
    width = classes + 2
    member = np.zeros((len(b), width))
    member[np.arange(len(b)), of] = 1
    n = member.T @ b @ member
    moved = 1
    while moved:
        moved = 0
        for w in order:
            old = of[w]
            member[w, old] = 0
            right, left, self_n = b[w] @ member, b[:, w] @ member, b[w, w]
            n[old] -= right
            n[:, old] -= left
            n[old, old] -= self_n
            # Gain of joining class k: its row gets `right`, its column `left`, its diagonal all three.
            fn, diag = _f(n), np.diag(n)
            rows = (_f(n + right) - fn).sum(1) - (_f(diag + right) - _f(diag))
            cols = (_f(n + left[:, None]) - fn).sum(0) - (_f(diag + left) - _f(diag))
            corner = _f(diag + left + right + self_n) - _f(diag)
            out, into = n.sum(1) + left, n.sum(0) + right  # a neighbour's own counts stay, wherever the word goes
            size_r, size_l = right.sum() + self_n, left.sum() + self_n
            gain = rows + cols + corner - (_f(out + size_r) - _f(out)) - (_f(into + size_l) - _f(into))
            new = int(np.argmax(gain[:classes]))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            moved += new != old
            of[w] = new
            member[w, new] = 1
            n[new] += right
            n[:, new] += left
            n[new, new] += self_n
    return of[:words]


def likelihood(n: np.ndarray) -> float:
    """The part of a corpus' log likelihood that depends on the classes, of their bigram counts."""
    return float(_f(n).sum() - _f(n.sum(0)).sum() - _f(n.sum(1)).sum())


def best_classes(n: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """For each word, the class that an exchange moves it to: its own where no other raises the likelihood.

    n: class bigram counts; of: the words' classes; left and right: how often a word's neighbours are of each class, without the
    word itself; own: how often it follows itself.
    """
    n, out = n.astype(np.float64), of.copy()
    for i in range(0, len(of), 1024):
        o, r, q, s = of[i : i + 1024], right[i : i + 1024].astype(np.float64), left[i : i + 1024].astype(np.float64), own[i : i + 1024].astype(np.float64)
        k = np.arange(len(o))
        m = np.repeat(n[None], len(o), 0)  # each word's counts without it
        m[k, o] -= r
        m[k, :, o] -= q
        m[k, o, o] -= s
        fm, diag = _f(m), np.einsum("kcc->kc", m)
        fd = _f(diag)
        rows = (_f(m + r[:, None]) - fm).sum(2) - (_f(diag + r) - fd)
        cols = (_f(m + q[:, :, None]) - fm).sum(1) - (_f(diag + q) - fd)
        corner = _f(diag + q + r + s[:, None]) - fd
        outs, ins = m.sum(2) + q, m.sum(1) + r  # a neighbour's own counts stay, wherever the word goes
        gain = rows + cols + corner - (_f(outs + (r.sum(1) + s)[:, None]) - _f(outs)) - (_f(ins + (q.sum(1) + s)[:, None]) - _f(ins))
        gain = gain[:, :classes]
        new = gain.argmax(1)
        out[i : i + 1024] = np.where((gain[k, new] > gain[k, np.minimum(o, classes - 1)] + 1e-9) & (o < classes), new, o)
    return out


def _context_model(bigrams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log P(neighbour's class | class), for the left and then the right neighbour: (CLASSES, 2 * WIDTH). Contexts: classes, end, other."""
    full = np.concatenate([of, [OTHER, END_CLASS]])
    member = np.zeros((len(full), WIDTH))
    member[np.arange(len(full)), full] = 1
    n = member.T @ bigrams @ member
    left, right = n.T[:CLASSES] + 0.5, n[:CLASSES] + 0.5
    return np.log(np.hstack([left / left.sum(1, keepdims=True), right / right.sum(1, keepdims=True)]))


ANSWER = "block long, bucket long, classes binary, counts binary, stats array<long>"


def _answers(blocks: DataFrame, seeds: np.ndarray, of: np.ndarray, model: np.ndarray, buckets: int) -> DataFrame:
    """For each block and bucket, the classes and training counts of the block's words; and a row of sums for each bucket."""
    sc = blocks.sparkSession.sparkContext
    shared = sc.broadcast((seeds, of, model))
    cells = 2 * WIDTH

    def ask(batches):
        seeds, of, _ = shared.value
        for x in batches:
            numbers = x.column(x.schema.get_field_index("block")).to_pylist()
            for number, b in zip(numbers, _each([x]), strict=True):
                before, own = b.pairs(b.labels(seeds, of, OTHER, END_CLASS), END_CLASS)
                t, here = b.train, b.tokens.astype(np.int64)
                keys = [here[t] * cells + before[t]]
                follows = t[1:] & (own[:-1] != END_CLASS)  # an end token is the left neighbour of the next document, nothing's own
                keys.append(here[:-1][follows] * cells + WIDTH + own[1:][follows])
                cell, n = np.unique(np.concatenate(keys), return_counts=True)
                bucket, cut = _bucket_of(b.words, buckets), _cuts(b, buckets)
                at = np.searchsorted(cell, cut * cells)
                out = [[], [], [], [], [], []]
                for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    mine = slice(at[k], at[k + 1])
                    for col, v in zip(out, (int(bucket[i]), number, b.words[i:j].tobytes(), _pack_ids(b.counts[i:j]), _pack_ascending(cell[mine] - i * cells), _pack_ids(n[mine])), strict=True):
                        col.append(v)
                kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "block", "words", "counts", "cells", "n"])

    def answer(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seeds, of, model = shared.value
        asked = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([_unpack_ids(c) for c in pdf["counts"]]), minlength=len(words)).astype(np.int64)
        # A word at a time in slices, so the dense table stays small.
        where, weight = _placed(asked, at, pdf, cells)
        of_word = np.empty(len(words), np.int64)
        for i in range(0, len(words), 20_000):
            j = min(len(words), i + 20_000)
            a, z = np.searchsorted(where, [i * cells, j * cells])
            table = np.bincount(where[a:z] - i * cells, weights=weight[a:z], minlength=(j - i) * cells).reshape(j - i, cells)
            of_word[i:j] = np.argmax(table @ model.T, axis=1)
        if len(seeds):
            k = np.minimum(np.searchsorted(seeds, words), len(seeds) - 1)
            hit = seeds[k] == words
            of_word[hit] = of[k[hit]]
        of_word[counts == 0] = UNKNOWN
        of_word[words == END] = END_CLASS
        live = counts > 0
        return _told(int(key[0]), pdf["block"], [len(w) for w in asked], at, of_word, counts)

    asked = blocks.select("block", *_USED).mapInArrow(ask, "bucket long, block long, words binary, counts binary, cells binary, n binary")
    return asked.groupBy("bucket").applyInPandas(answer, ANSWER)


def _told(bucket: int, blocks, sizes: list[int], at: np.ndarray, of_word: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """A bucket's answers, by block, and its row of sums. `at`: places of the blocks' words, in turn, among the bucket's."""
    live = counts > 0
    stats = [int(live.sum()), int((counts == 1).sum()), *np.bincount(of_word[live], weights=counts[live], minlength=WIDTH).astype(np.int64).tolist()]
    rows, first = [(None, bucket, None, None, stats)], 0
    for number, n in zip(blocks, sizes, strict=True):
        mine = at[first : first + n]
        rows.append((int(number), bucket, _pack(of_word[mine].astype(np.uint8)), _pack(counts[mine]), None))
        first += n
    out = pd.DataFrame(rows, columns=["block", "bucket", "classes", "counts", "stats"])
    out["block"] = out["block"].astype("Int64")
    return out


CONTEXT = "bucket long, block long, words binary, counts binary, classes binary, cells binary, n binary, matrix array<long>"
CELLS = 2 * WIDTH + 1  # classes of left neighbours, of right ones, and how often a word follows itself


def _contexts(blocks: DataFrame, answers: DataFrame, buckets: int) -> DataFrame:
    """For each bucket, the contexts of the block's words under the present classes; the first row has the block's class bigrams."""

    def run(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values("bucket")
        b = Block(*(own.iloc[0][c] for c in _USED))
        of = np.concatenate([_unpack(x, np.uint8) for x in told["classes"]]).astype(np.int64)
        counts = np.concatenate([_unpack(x, np.int64) for x in told["counts"]])
        before, mine = b.pairs(of, END_CLASS)
        t, here = b.train, b.tokens.astype(np.int64)
        matrix = np.bincount((before * WIDTH + mine)[t], minlength=WIDTH**2)
        twice = np.concatenate([[False], (here[1:] == here[:-1]) & (mine[1:] != END_CLASS)])
        keys = [here[t & twice] * CELLS + 2 * WIDTH, here[t & ~twice] * CELLS + before[t & ~twice]]
        follows = t[1:] & (mine[:-1] != END_CLASS) & ~twice[1:]
        keys.append(here[:-1][follows] * CELLS + WIDTH + mine[1:][follows])
        cell, n = np.unique(np.concatenate(keys), return_counts=True)
        cut = _cuts(b, buckets)
        at = np.searchsorted(cell, cut * CELLS)
        rows = []
        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            part = slice(at[k], at[k + 1])
            bucket = int(_bucket_of(b.words[i : i + 1], buckets)[0])
            rows.append((bucket, int(key[0]), b.words[i:j].tobytes(), _pack(counts[i:j]), _pack(of[i:j].astype(np.uint8)), _pack_ascending(cell[part] - i * CELLS), _pack_ids(n[part]), None if k else matrix.tolist()))
        return pd.DataFrame(rows, columns=["bucket", "block", "words", "counts", "classes", "cells", "n", "matrix"])

    return blocks.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block")).applyInPandas(run, CONTEXT)


def _matrix(rows: DataFrame) -> np.ndarray:
    """The sum of the class bigrams in `matrix`: WIDTH ** 2 numbers."""
    cells = rows.filter("matrix is not null").select(F.posexplode("matrix")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    return np.array([r.n for r in cells] or [0] * WIDTH**2, np.int64).reshape(WIDTH, WIDTH)


def _swept(contexts: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Answers after one exchange sweep over all words."""
    shared = contexts.sparkSession.sparkContext.broadcast(matrix)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [np.frombuffer(w, np.uint64) for w in pdf["words"]]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        of, counts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        of[at] = np.concatenate([_unpack(x, np.uint8) for x in pdf["classes"]])
        counts[at] = np.concatenate([_unpack(x, np.int64) for x in pdf["counts"]])
        where, weight = _placed(asked, at, pdf, CELLS)
        for i in range(0, len(words), 20_000):
            j = min(len(words), i + 20_000)
            a, z = np.searchsorted(where, [i * CELLS, j * CELLS])
            t = np.bincount(where[a:z] - i * CELLS, weights=weight[a:z], minlength=(j - i) * CELLS).reshape(j - i, CELLS)
            moves = np.flatnonzero(of[i:j] < CLASSES)
            t = t[moves]
            of[i + moves] = best_classes(shared.value, of[i + moves], t[:, :WIDTH], t[:, WIDTH : 2 * WIDTH], t[:, -1], CLASSES)
        return _told(int(key[0]), pdf["block"], [len(w) for w in asked], at, of, counts)

    return contexts.drop("matrix").groupBy("bucket").applyInPandas(run, ANSWER)


def _placed(asked: list[np.ndarray], at: np.ndarray, pdf: pd.DataFrame, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The blocks' cells by word of the bucket, sorted, and their counts."""
    where, weight, first = [], [], 0
    for w, c, n in zip(asked, pdf["cells"], pdf["n"], strict=True):
        c = _unpack_ascending(c)
        where.append(at[first : first + len(w)][c // cells] * cells + c % cells)
        weight.append(_unpack_ids(n))
        first += len(w)
    where, weight = np.concatenate(where), np.concatenate(weight)
    order = np.argsort(where, kind="stable")
    return where[order], weight[order].astype(np.float64)


PROFILE = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, emission double, moves binary, times binary, matrix array<long>"


def _profiles(blocks: DataFrame, answers: DataFrame, n: int, v: int, sizes: np.ndarray) -> DataFrame:
    """Each document's sums and class bigrams; the first row of a block also has the block's training class bigrams."""
    shared = blocks.sparkSession.sparkContext.broadcast(sizes)

    def run(key: tuple, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r, told = own.iloc[0], told.sort_values("bucket")
        b = Block(*(r[c] for c in _USED))
        of = np.concatenate([_unpack(x, np.uint8) for x in told["classes"]]).astype(np.int64)
        counts = np.concatenate([_unpack(x, np.int64) for x in told["counts"]])
        before, mine = b.pairs(of, END_CLASS)
        known = counts > 0
        base = np.log10((counts + 1) / (n + v + 1))
        emission = np.where(known, np.log10(np.maximum(counts, 1) / np.maximum(shared.value[of], 1)), 0.0)
        ends = np.cumsum(b.lengths)
        starts = ends - b.lengths
        per = lambda x: np.add.reduceat(x[b.tokens], starts)
        move = before * WIDTH + mine
        doc = np.repeat(np.arange(len(starts)), b.lengths)
        key_, times = np.unique(doc * WIDTH**2 + move, return_counts=True)
        cut = np.searchsorted(key_, np.arange(len(starts) + 1) * WIDTH**2)
        held = np.frombuffer(r["held"], np.uint8).astype(bool)
        total = np.bincount(move[b.train], minlength=WIDTH**2)
        key_ = (key_ % WIDTH**2).astype(np.uint16)
        ids = np.frombuffer(r["doc_ids"], np.int64)
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": held, "n_tokens": b.lengths, "n_known": per(known.astype(np.int64)), "base": per(base), "emission": per(emission)})
        out.loc[ids == _NONE, "doc_id"] = pd.NA
        out["moves"] = [key_[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        out["times"] = [times[i:j].astype(np.uint32).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        out["matrix"] = [total.tolist()] + [None] * (len(out) - 1)
        return out

    return blocks.groupBy("block").cogroup(answers.filter("block is not null").groupBy("block")).applyInPandas(run, PROFILE)


def transition_logs(bigrams: np.ndarray, sizes: np.ndarray, unknown: float) -> np.ndarray:
    """log10 P(class | class before), rows sum to 1: unknown words have a fixed share, the rest backs off to the classes' own shares."""
    n = bigrams.astype(np.float64).copy()
    share = np.where(np.arange(WIDTH) == UNKNOWN, 0, sizes).astype(np.float64)
    share /= max(share.sum(), 1)
    n[:, UNKNOWN] = 0
    p = (1 - unknown) * (n + SMOOTH * share) / (n.sum(1, keepdims=True) + SMOOTH)
    p[:, UNKNOWN] = unknown
    return np.log10(np.maximum(p, 1e-300))


def clustered(blocks: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame | None, float | None]:
    """The answers (ANSWER) after the clustering of all training words; and, where their likelihood is not known yet, those before the
    last sweep with theirs: the caller's own pass counts the class bigrams, and takes the older ones if they have not become likelier."""
    seeds = _seeds(blocks, buckets)
    bigrams = _seed_bigrams(blocks, seeds)
    of = exchange(bigrams, CLASSES)
    answers = common.materialise(_answers(blocks, seeds, of, _context_model(bigrams, of), buckets), "lm-answers", "none")
    best, before = None, None
    for _ in range(SWEEPS):
        contexts = common.materialise(_contexts(blocks, answers, buckets), "lm-contexts", "none")
        matrix = _matrix(contexts)
        now = likelihood(matrix)
        if best is not None and now <= best:  # too many moved at once
            common.release(answers, contexts)
            return before, None, None
        if before is not None:
            common.release(before)
        best, before, answers = now, answers, common.materialise(_swept(contexts, matrix), "lm-answers", "none")
        common.release(contexts)
    return answers, before, best


def vocabulary(answers: DataFrame) -> tuple[int, int, np.ndarray]:
    """How many training words there are, how many of them once, and each class' tokens."""
    sums = answers.filter("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).orderBy("pos").collect()
    v, once, *sizes = [r.n for r in sums] or [0] * (WIDTH + 2)
    return v, once, np.array(sizes, np.int64)


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    docs = common.documents(docs)
    sc = docs.sparkSession.sparkContext
    blocks = common.materialise(_blocks(docs, block_tokens), "lm-blocks", "none")
    asked, n = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("train_tokens"), F.lit(0))).first()
    buckets = max(common.parallelism(docs.sparkSession), -(-asked // per_bucket))
    answers, before, best = clustered(blocks, buckets)
    while True:
        v, once, sizes = vocabulary(answers)
        profiles = common.materialise(_profiles(blocks, answers, n, v, sizes), "lm-profiles")
        matrix = _matrix(profiles)
        common.release(answers)
        if before is None or likelihood(matrix) > best:
            break
        common.release(profiles)
        answers, before = before, None
    common.release(blocks, *([before] if before is not None else []))
    unknown = min(0.5, (once + 1) / (n + 2))
    logs = sc.broadcast(transition_logs(matrix, sizes, unknown).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moves, times = b.column(6).to_pylist(), b.column(7).to_pylist()
            s = [float(np.dot(logs.value[np.frombuffer(m, np.uint16)], np.frombuffer(t, np.uint32))) for m, t in zip(moves, times, strict=True)]
            base = b.column(4)
            total = np.array(s) + b.column(5).to_numpy() if n else base.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(np.full(b.num_rows, n, np.int64)), base, pa.array(total, pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return profiles.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
