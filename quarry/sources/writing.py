"""Writes archives and the indexes inside them: the inverse of what zim and glass read.

An archive is made in memory, so it is for archives of bounded size: write_archives() cuts a table into many, each in one task.
"""

from __future__ import annotations

import hashlib
import lzma
import struct
import zlib
from collections.abc import Callable

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame

from quarry.sources import glass as G
from quarry.sources import zim

NONE, XZ, ZSTD = 0, 4, 5
#: XZ's light preset: quicker on clusters of a few texts, and its dictionary is 1 MB, not 8.
_PACK = {NONE: bytes, XZ: lambda b: lzma.compress(b, preset=1), ZSTD: lambda b: zstandard.ZstdCompressor().compress(b)}


def _cluster(blobs: list[bytes], codec: int, wide: bool) -> bytes:
    unit = "<Q" if wide else "<I"
    at, table = struct.calcsize(unit) * (len(blobs) + 1), b""
    for b in [*blobs, b""]:
        table += struct.pack(unit, at)
        at += len(b)
    return bytes([codec | (0x10 if wide else 0)]) + _PACK[codec](table + b"".join(blobs))


def archive(entries: list[tuple[str, str, str, bytes | str]], codec: int = ZSTD, wide: bool = False, per_cluster: int = 2, main: int | str | None = 0, listing: bool = False) -> bytes:
    """An archive of entries (ns, path, title, content, or the path of a redirect's target). Index entries are stored uncompressed.

    main: the header's main page, by number or by path; listing: adds the listing of C entries in order of title.
    """
    entries = sorted(entries, key=lambda e: (e[0], e[1].encode()))
    if listing:
        place = "listing/titleOrdered/v1"
        entries = sorted([*entries, ("X", place, "", b"")], key=lambda e: (e[0], e[1].encode()))
        order = sorted((k for k, e in enumerate(entries) if e[0] == "C"), key=lambda k: ((entries[k][2] or entries[k][1]).encode(), k))
        entries = [(ns, path, title, struct.pack(f"<{len(order)}I", *order)) if (ns, path) == ("X", place) else (ns, path, title, content) for ns, path, title, content in entries]
    mimes = b"text/html\0text/plain\0application/octet-stream\0\0"
    items = [e for e in entries if isinstance(e[3], bytes)]
    plain = [e for e in items if e[0] == "X"]
    packed = [e for e in items if e[0] != "X"]
    where, clusters = {}, []
    for own, kind in ((packed, codec), (plain, codec if codec != ZSTD and codec != XZ else NONE)):
        for k in range(0, len(own), per_cluster):
            part = own[k : k + per_cluster]
            where |= {(e[0], e[1]): (len(clusters), i) for i, e in enumerate(part)}
            clusters.append(_cluster([e[3] for e in part], kind, wide))
    number = {(e[0], e[1]): k for k, e in enumerate(entries)}
    dirents = []
    for ns, path, title, content in entries:
        tail = path.encode() + b"\0" + (b"" if title == path else title.encode()) + b"\0"
        if isinstance(content, bytes):
            mime = 2 if ns == "X" else 1 if ns == "M" else 0
            dirents.append(struct.pack("<HBBIII", mime, 0, ord(ns), 0, *where[ns, path]) + tail)
        else:
            dirents.append(struct.pack("<HBBII", zim.REDIRECT, 0, ord(ns), 0, number[("C" if ns == "W" else ns), content]) + tail)
    at = 80 + len(mimes)
    path_ptr, at = at, at + 8 * len(entries)
    cluster_ptr, at = at, at + 8 * len(clusters)
    places = []
    for part in (*dirents, *clusters):
        places.append(at)
        at += len(part)
    pointers = struct.pack(f"<{len(places)}Q", *places)
    page = zim.NONE32 if main is None else number["C", main] if isinstance(main, str) else main
    head = struct.pack("<IHH16sIIQQQQIIQ", zim.MAGIC, 6, 3, bytes(range(16)), len(entries), len(clusters), path_ptr, zim.NONE64, cluster_ptr, 80, page, zim.NONE32, at)
    data = head + mimes + pointers + b"".join(dirents) + b"".join(clusters)
    return data + hashlib.md5(data).digest()


def write_archives(rows: DataFrame, folder: str, make: Callable[[pd.DataFrame], bytes], name: str = "archive") -> DataFrame:
    """One archive for each value of column `name`, as <folder>/<value>.zim in the shared folder: (file, size). Groups are of bounded size."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        data, path = make(pdf), f"{root}/{key[0]}.zim"
        with files.open_output_stream(path) as f:
            f.write(data)
        return pd.DataFrame({"file": [path], "size": [len(data)]})

    return rows.groupBy(name).applyInPandas(run, "file string, size long")


# Indexes ------------------------------------------------------------------------------------------------------------------


def bits_of(parts):
    """(value, n) below n, in truncated binary codes, the lowest bit first."""
    value = at = 0
    for v, n in parts:
        size = (n - 1).bit_length()
        spare = (1 << size) - n
        half = (n - spare) // 2
        if not spare:
            code, k = v, size
        elif v < half:
            code, k = v, size  # a zero follows the shorter code
        elif v >= half + spare:
            code, k = v - half - spare | 1 << size - 1, size
        else:
            code, k = v, size - 1
        value |= code << at
        at += k
    return value.to_bytes((at + 7) // 8, "little")


def pack_positions(pos):
    if len(pos) == 1:  # most terms of a document
        return G.pack_number(pos[0])
    parts = [(pos[0], pos[-1]), (len(pos) - 2, pos[-1] - pos[0])]

    def middle(j, k):
        if k - j > 1:
            mid = j + (k - j) // 2
            parts.append((pos[mid] - pos[j] - (mid - j), pos[k] - pos[j] + 1 - (k - j)))
            middle(j, mid)
            middle(mid, k)

    middle(0, len(pos) - 1)
    return G.pack_number(pos[-1]) + bits_of(parts)


def posting_entries(term, posts, per_chunk):
    out, pack, n = {}, G.pack_number, len(posts)
    for i in range(0, n, per_chunk):
        part = posts[i : i + per_chunk]
        before, wdf = part[0]
        head = pack(n) + pack(sum([w for _, w in posts])) + pack(before - 1) if i == 0 else b""
        tags = [head, b"1" if i + per_chunk >= n else b"0", pack(part[-1][0] - before), pack(wdf)]
        for d, w in part[1:]:
            tags += pack(d - before - 1), pack(w)
            before = d
        out[G.posting_key(term, part[0][0] if i else None)] = b"".join(tags)
    return out


class Builder:
    def __init__(self, block_size=2048):
        self.size, self.blocks = block_size, [b""]  # block 0 is the header

    def _block(self, level, items):
        body, places = bytearray(self.size), []
        at = self.size
        for i in items:
            at -= len(i)
            body[at : at + len(i)] = i
            places.append(at)
        body[4] = level
        end = G.DIRECTORY + 2 * len(items)
        assert end <= at
        struct.pack_into(">H", body, 9, end)
        struct.pack_into(f">{len(places)}H", body, G.DIRECTORY, *places)
        self.blocks.append(bytes(body))
        return len(self.blocks) - 1

    def _level(self, level, items):
        """items: (key, part, bytes). Returns the blocks as items of the level above."""
        out, now, room = [], [], self.size - G.DIRECTORY
        for x in [*items, None]:
            if x is None or room < len(x[2]) + 2:
                key, part = (b"", 1) if not out else now[0][:2]
                out.append((key, part, self._block(level, [b for _, _, b in now])))
                now, room = [], self.size - G.DIRECTORY
            if x is not None:
                now.append(x)
                room -= len(x[2]) + 2
        return [(k, p, struct.pack(">I", n) + bytes([len(k)]) + k + struct.pack(">H", p)) for k, p, n in out]

    def table(self, entries, compress=()):
        """(root block, level, entries)."""
        if not entries:
            return None
        items, most = [], self.size // 4
        for key in sorted(entries):
            tag, flag = entries[key], 0
            if key in compress:
                c = zlib.compressobj(wbits=-15)
                tag, flag = c.compress(tag) + c.flush(), G.COMPRESSED
            start = bytes([len(key)]) + key
            if len(tag) <= most:  # nearly every one
                items.append((key, 1, ((flag | G.FIRST | G.LAST) << 8 | len(start) + len(tag) - 1).to_bytes(2, "big") + start + tag))
                continue
            parts = [tag[i : i + most] for i in range(0, len(tag), most)]
            for k, body in enumerate(parts):
                head = start + (b"" if k == 0 else struct.pack(">H", k + 1)) + body
                flags = flag | (G.FIRST if k == 0 else 0) | (G.LAST if k == len(parts) - 1 else 0)
                items.append((key, k + 1, struct.pack(">H", flags << 8 | len(head) - 1) + head))
        level, up = 0, self._level(0, items)
        while len(up) > 1:
            level += 1
            up = self._level(level, up)
        return struct.unpack_from(">I", up[0][2])[0], level, len(entries)

    def finish(self, tables, stats):
        head = G.MAGIC + G.VERSION.to_bytes(2, "big") + bytes(16) + G.pack_number(7)
        for name in G.TABLES:
            block, level, n = tables.get(name) or (0, 0, 0)
            shape = level << 2 | (0 if tables.get(name) else 1)
            head += b"".join(map(G.pack_number, (block, shape, n, self.size >> 11, 4))) + G.pack_number(0)
        head += b"".join(map(G.pack_number, stats))
        self.blocks[0] = head.ljust(self.size, b"\0")
        return b"".join(self.blocks)


def database(terms, data, positions=None, values=None, meta=None, block_size=2048, per_chunk=20):
    """terms: {term: [(docid, wdf)]}; data: {docid: bytes}; positions: {(term, docid): [...]}; values: {slot: {docid: bytes}}."""
    lengths = {}
    for posts in terms.values():
        for d, w in posts:
            lengths[d] = lengths.get(d, 0) + w
    for d in data:
        lengths.setdefault(d, 0)
    post = {G.META + k.encode(): v for k, v in (meta or {}).items()}
    for slot, own in (values or {}).items():
        docs = sorted(own)
        low, high = min(own.values()), max(own.values())
        number = slot.to_bytes((slot.bit_length() + 7) // 8, "little")
        post[G.SLOT_STATS + number] = G.pack_number(len(docs)) + G.pack_number(len(low)) + low + (b"" if low == high else high)
        for i in range(0, len(docs), per_chunk):
            tags, before = [], None
            for d in docs[i : i + per_chunk]:
                tags += b"" if before is None else G.pack_number(d - before - 1), G.pack_number(len(own[d])), own[d]
                before = d
            post[G.SLOT + G.pack_number(slot) + G.pack_ordered_number(docs[i])] = b"".join(tags)
    post |= posting_entries(b"", sorted(lengths.items()), per_chunk)
    for t, posts in terms.items():
        post |= posting_entries(t, sorted(posts) if len(posts) > 1 else posts, per_chunk)
    b = Builder(block_size)
    tables = {
        "postlist": b.table(post),
        "docdata": b.table({G.pack_ordered_number(d): v for d, v in data.items()}, {G.pack_ordered_number(d) for d, v in data.items() if len(v) > 60}),
        "position": b.table({G.pack_ordered_text(t) + G.pack_ordered_number(d): pack_positions(p) for (t, d), p in (positions or {}).items()}),
    }
    wdf = max((w for p in terms.values() for _, w in p), default=0)
    longest = max(lengths.values(), default=0)
    return b.finish(tables, [len(lengths), max(lengths, default=0) - len(lengths), min(lengths.values(), default=0), wdf, longest - wdf, 0, sum(lengths.values()), 0])
