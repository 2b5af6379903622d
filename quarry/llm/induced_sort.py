"""External induced suffix sorting with common-prefix values, in batches.

Suffixes are of type L or S by comparison with their right neighbour. The S* suffixes (S after L) are sorted by their first
DEPTH bytes, which is as deep as common prefixes are ever asked for; all other suffixes are induced: a scan in order pushes the
left neighbour of each suffix into the queue of its first byte. The scan visits suffixes in sorted order, so each byte's entries
arrive sorted: 256 first-in-first-out queues are a priority queue over (byte, arrival). Queues hold tuples of position and common
prefix with the entry before, in arrays; above `memory` bytes they write arrays to files of the spill folder.

Common prefixes are carried along: two entries induced one after the other share one byte more than the least common prefix
met between their origins. Values are capped at DEPTH.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

DEPTH = 56
STEP = 1 << 20


class Spill:
    """Where queues put arrays that don't fit in memory: a folder that outlives no sort."""

    def __init__(self, folder: str | None, memory: int):
        self.folder, self.memory, self.held, self.fs, self.n = folder, memory, 0, None, 0

    def _open(self):
        if self.fs is None:
            self.fs, root = fs.FileSystem.from_uri(self.folder)
            self.root = f"{root}/sort-{uuid.uuid4().hex}"
            self.fs.create_dir(self.root, recursive=True)

    def put(self, a: np.ndarray):
        if self.folder is None or self.held + a.nbytes <= self.memory:
            self.held += a.nbytes
            return a
        self._open()
        self.n += 1
        path = f"{self.root}/{self.n}"
        with self.fs.open_output_stream(path) as f:
            f.write(a.tobytes())
        return path, a.dtype, a.shape

    def get(self, item, keep: bool = False) -> np.ndarray:
        if isinstance(item, np.ndarray):
            self.held -= 0 if keep else item.nbytes
            return item
        path, kind, shape = item
        with self.fs.open_input_file(path) as f:
            a = np.frombuffer(f.read(), kind).reshape(shape)
        if not keep:
            self.fs.delete_file(path)
        return a

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.root)


class Queue:
    """First in, first out: arrays of positions and of common prefixes."""

    def __init__(self, spill: Spill):
        self.spill, self.items = spill, []

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        for i in range(0, len(at), STEP):
            self.items.append((self.spill.put(at[i : i + STEP]), self.spill.put(lcp[i : i + STEP])))

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches in order, those pushed meanwhile included; small ones that wait are joined."""
        while self.items:
            take, size = [], 0
            while self.items and size < STEP:
                a, b = self.items.pop(0)
                take.append((self.spill.get(a), self.spill.get(b)))
                size += len(take[-1][0])
            yield np.concatenate([x[0] for x in take]), np.concatenate([x[1] for x in take])

    def drain_back(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches from the last to the first, each reversed."""
        while self.items:
            a, b = self.items.pop()
            yield self.spill.get(a)[::-1], self.spill.get(b)[::-1]


class _Carry:
    """Least common prefix met since each byte's last entry was pushed."""

    def __init__(self):
        self.low = np.zeros(256, np.int64)

    def push(self, queues: dict, spill: Spill, byte: np.ndarray, at: np.ndarray, lcp: np.ndarray, chosen: np.ndarray) -> None:
        """lcp[i]: of scanned entry i with the one scanned before it. Chosen entries are pushed to their byte's queue."""
        if not len(lcp):
            return
        where = np.flatnonzero(chosen)
        seen = np.unique(byte[where]) if len(where) else []
        lowest = int(lcp.min())
        new = np.minimum(self.low, lowest)
        for c in seen:
            idx = where[byte[where] == c]
            out = np.empty(len(idx), np.int64)
            out[0] = 1 + min(int(self.low[c]), int(lcp[: idx[0] + 1].min()))
            if len(idx) > 1:
                out[1:] = 1 + np.minimum.reduceat(lcp[1 : idx[-1] + 1], idx[:-1])
            q = queues.get(int(c))
            if q is None:
                q = queues[int(c)] = Queue(spill)
                out[0] = 0
            q.push(at[idx], np.minimum(out, DEPTH).astype(np.uint8))
            rest = lcp[idx[-1] + 1 :]
            new[c] = int(rest.min()) if len(rest) else DEPTH
        self.low = new


def _common(text: np.ndarray, p: int, q: int) -> int:
    a, b = text[p : p + DEPTH], text[q : q + DEPTH]
    n = min(len(a), len(b))
    d = np.flatnonzero(a[:n] != b[:n])
    return int(d[0]) if len(d) else n


def _sort_seeds(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes by their first DEPTH bytes (shorter first), and the common prefix of each with the one before."""
    padded = np.concatenate([text, np.zeros(DEPTH + 8, np.uint8)])
    weights = [np.uint64(1 << 8 * (7 - k)) for k in range(8)]

    def word(p: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(p), np.uint64)
        for j in range(8):
            out += padded[p + (8 * k + j)].astype(np.uint64) * weights[j]
        return out

    first = word(at, 0)
    order = np.argsort(first, kind="stable")
    at, key = at[order], first[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.empty(0, np.int64)
    lcp = np.zeros(len(at), np.int64)

    def shared(x: np.ndarray) -> np.ndarray:  # equal leading bytes of two words that differ
        high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
        return (64 - np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])) // 8

    if len(at) > 1:
        x = key[1:] ^ key[:-1]
        lcp[1:] = np.where(x == 0, 8, np.minimum(shared(x), 7))
    for k in range(1, DEPTH // 8):
        same = np.concatenate([[False], group[1:] == group[:-1]])
        tied = same | np.concatenate([same[1:], [False]])
        idx = np.flatnonzero(tied)
        if not len(idx):
            break
        key = word(at[idx], k)
        order = np.lexsort((key, group[idx]))
        at[idx], key = at[idx][order], key[order]
        x = np.concatenate([[np.uint64(0)], key[1:] ^ key[:-1]])
        more = same[idx]  # the first of a group keeps its value
        lcp[idx[more]] = 8 * k + np.where(x[more] == 0, 8, np.minimum(shared(x[more]), 7))
        split = np.zeros(len(at), np.int64)
        split[idx] = more & (x != 0)
        group = group + np.cumsum(split)
    return at, lcp


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; from the end, STEP bytes at a time."""
    n = len(text)
    out = np.zeros(n, bool)  # the last suffix is L: nothing follows, which is less than any byte
    for hi in range(n - 1, 0, -STEP):
        lo = max(0, hi - STEP)
        a, b = text[lo:hi], text[lo + 1 : hi + 1]
        differ = np.flatnonzero(a != b)  # a byte that equals the next is as that
        at = np.searchsorted(differ, np.arange(hi - lo))
        known = at < len(differ)
        up = (a < b)[differ]
        out[lo:hi][known] = up[at[known]]
        out[lo:hi][~known] = out[hi]
    return out


def suffixes_descending(text: np.ndarray, spill_folder: str | None = None, memory: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (position, common prefix with the suffix scanned before) over all suffixes, greatest first.

    Order and common prefixes hold to DEPTH bytes. The text must end with a byte that is less than all others, or any byte if
    suffixes that run to the end are of no interest. text: uint8.
    """
    n = len(text)
    if not n:
        return
    is_s = _types(text)
    stars = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    spill = Spill(spill_folder, memory)
    try:
        seeds, seed_lcp = _sort_seeds(text, stars.astype(np.int64))
        first = text[seeds]
        bounds = np.searchsorted(first, np.arange(257))
        # Left to right: L suffixes. The last suffix is the least of its byte.
        queues: dict[int, Queue] = {}
        left: dict[int, Queue] = {}
        carry, last = _Carry(), int(text[-1])
        queues[last] = Queue(spill)
        queues[last].push(np.array([n - 1]), np.zeros(1, np.uint8))
        for c in range(256):
            end = -1
            q = queues.get(c)
            if q is not None:
                left[c] = Queue(spill)
                while q.items:
                    for at, lcp in q.drain():
                        left[c].push(at, lcp)
                        end = int(at[-1])
                        before = np.maximum(at - 1, 0)
                        ok = (at > 0) & ~is_s[before]
                        carry.push(queues, spill, text[before], before, lcp.astype(np.int64), ok)
            lo, hi = bounds[c], bounds[c + 1]
            for i in range(lo, hi, STEP):
                at, lcp = seeds[i : min(hi, i + STEP)], seed_lcp[i : min(hi, i + STEP)].copy()
                if i == lo:
                    lcp[0] = _common(text, end, int(at[0])) if end >= 0 else 0
                carry.push(queues, spill, text[at - 1], at - 1, lcp, np.ones(len(at), bool))
        # Right to left: S suffixes; every suffix passes by, in descending order.
        queues, carry = {}, _Carry()
        for c in range(255, -1, -1):
            end = -1
            q = queues.get(c)
            if q is not None:
                while q.items:
                    for at, lcp in q.drain():
                        yield at, lcp
                        end = int(at[-1])
                        before = np.maximum(at - 1, 0)
                        carry.push(queues, spill, text[before], before, lcp.astype(np.int64), (at > 0) & is_s[before])
            if c in left:
                held = None
                for at, up in left[c].drain_back():
                    # up[i]: with the next lower one; turned round, each entry has the value of the one above it.
                    lcp = np.empty(len(at), np.int64)
                    lcp[0] = held if held is not None else (_common(text, end, int(at[0])) if end >= 0 else 0)
                    lcp[1:] = up[:-1]
                    held = int(up[-1])
                    yield at, lcp.astype(np.uint8)
                    before = np.maximum(at - 1, 0)
                    carry.push(queues, spill, text[before], before, lcp, (at > 0) & is_s[before])
    finally:
        spill.close()
