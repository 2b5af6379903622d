"""ZIM archives as DataFrames: a Python data source that plans by the 80-byte header and decodes a range of entries a task.

    zim.register(spark)
    spark.read.format("zim").option("path", "/books/a.zim").load()                    # entries
    spark.read.format("zim").option("path", ...).option("table", "blobs").load()      # decoded blobs, by cluster
    spark.read.format("zim").option("path", ...).option("table", "titles").load()     # entry numbers in order of title

Archives may be split (`.zimaa`, `.zimab`, ...) or lie inside another file (options offset and length).
"""

from __future__ import annotations

import hashlib
import lzma
import mmap
import os
import struct
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

MAGIC, NONE32, NONE64 = 0x044D495A, 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF
REDIRECT, LINKTARGET, DELETED = 0xFFFF, 0xFFFE, 0xFFFD
ENTRIES = "archive string, idx long, ns string, path string, title string, kind string, mime string, cluster long, blob long, redirect_idx long"
BLOBS = "archive string, cluster long, blob long, size long, content binary"
TITLES = "archive string, position long, idx long"
#: The most bytes that a cluster may decode to.
MAX_CLUSTER = 1 << 31


class ZimError(ValueError):
    """The bytes are no valid archive."""


class Bytes:
    """Random access to a file, to consecutive parts, to ranges of files, or to bytes in memory; each optionally narrowed to a range.

    Files are mapped into memory when first read and stay mapped, so a read copies no more than what is asked for.
    """

    def __init__(self, source: str | bytes | list[tuple[str, int, int]], offset: int = 0, length: int | None = None):
        if isinstance(source, bytes):
            self.pieces = [(source, 0, len(source))]
        elif isinstance(source, list):
            self.pieces = [(path, at, n) for path, at, n in source]
        elif source.lower().endswith(".zimaa"):
            stem, self.pieces = source[:-2], []
            while os.path.exists(name := stem + chr(97 + len(self.pieces) // 26) + chr(97 + len(self.pieces) % 26)):
                self.pieces.append((name, 0, os.path.getsize(name)))
        else:
            self.pieces = [(source, 0, os.path.getsize(source))]
        for path, at, n in self.pieces:
            if at < 0 or n < 0 or isinstance(path, str) and at + n > os.path.getsize(path):
                raise ZimError(f"range outside {path}")
        total = sum(n for _, _, n in self.pieces)
        self.offset, self.size = offset, total - offset if length is None else length
        if offset < 0 or self.size < 0 or offset + self.size > total:
            raise ZimError("range outside the file")
        self.maps: dict[str, mmap.mmap] = {}

    def _bytes(self, path):
        if isinstance(path, bytes):
            return path
        if path not in self.maps:
            with open(path, "rb") as f:
                self.maps[path] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return self.maps[path]

    def ranges(self, at: int, n: int) -> list[tuple]:
        """Where the bytes lie: (file, offset, length) for each piece."""
        if at < 0 or n < 0 or at + n > self.size:
            raise ZimError(f"read of {n} bytes at {at} outside {self.size}")
        at, out = at + self.offset, []
        for path, first, size in self.pieces:
            if n and at < size:
                out.append((path, first + at, min(n, size - at)))
                n -= out[-1][2]
                at += out[-1][2]
            at -= size
        return out

    def read(self, at: int, n: int) -> bytes:
        return b"".join(bytes(self._bytes(path)[a : a + k]) for path, a, k in self.ranges(at, n))


@dataclass(frozen=True)
class Header:
    major: int
    minor: int
    uuid: str
    entry_count: int
    cluster_count: int
    path_ptr: int
    title_ptr: int | None
    cluster_ptr: int
    mime_ptr: int
    main_page: int | None
    layout_page: int | None
    checksum_ptr: int | None

    @property
    def new_scheme(self) -> bool:
        return self.minor >= 1


def parse_header(data: bytes, size: int) -> Header:
    if len(data) < 72:
        raise ZimError("shorter than a header")
    magic, major, minor, uid, entries, clusters, path, title, cluster, mime, main, layout = struct.unpack_from("<IHH16sIIQQQQII", data)
    if magic != MAGIC:
        raise ZimError("wrong magic number")
    if major not in (5, 6):
        raise ZimError(f"unknown version {major}")
    if mime not in (72, 80):
        raise ZimError("misplaced MIME list")
    checksum = struct.unpack_from("<Q", data, 72)[0] if mime == 80 and len(data) >= 80 else None
    if checksum is not None and checksum != size - 16:
        raise ZimError("misplaced checksum")
    for at, n in ((path, 8 * entries), (cluster, 8 * clusters)):
        if at + n > size:
            raise ZimError("pointer list outside the file")
    if title != NONE64 and title + 4 * entries > size:
        raise ZimError("title list outside the file")
    if main != NONE32 and main >= entries:
        raise ZimError("main page outside the entries")
    h = uid.hex()
    return Header(major, minor, f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", entries, clusters, path, None if title == NONE64 else title, cluster, mime, None if main == NONE32 else main, None if layout == NONE32 else layout, checksum)


def decode_cluster(data: bytes, entries: int) -> list[bytes]:
    """The blobs of a cluster that begins at data[0]; bytes after it are ignored."""
    info = data[0]
    kind, width, payload = info & 0x0F, 8 if info & 0x10 else 4, data[1:]
    if kind == 4:
        payload = lzma.LZMADecompressor(memlimit=MAX_CLUSTER).decompress(payload, MAX_CLUSTER)
    elif kind == 5:
        import zstandard

        payload = zstandard.ZstdDecompressor().decompressobj().decompress(payload)
    elif kind not in (0, 1):
        raise ZimError(f"unsupported compression {kind}")
    unit = "<Q" if width == 8 else "<I"
    if len(payload) < width:
        raise ZimError("empty cluster")
    first = struct.unpack_from(unit, payload)[0]
    if first % width or first < width or first > len(payload) or first // width - 1 > entries:
        raise ZimError("bad first offset")
    offsets = [struct.unpack_from(unit, payload, k * width)[0] for k in range(first // width)]
    if any(a > b for a, b in zip(offsets, offsets[1:])) or offsets[-1] > len(payload):
        raise ZimError("offsets not ascending or outside the cluster")
    return [payload[a:b] for a, b in zip(offsets, offsets[1:])]


class Archive:
    """One archive: header, MIME list, entries by index or path, title order, clusters, checksum."""

    def __init__(self, source: str | bytes | list[tuple[str, int, int]], offset: int = 0, length: int | None = None):
        self.source = Bytes(source, offset, length)
        self.header = parse_header(self.source.read(0, min(80, self.source.size)), self.source.size)
        h = self.header
        end = min(x for x in (h.path_ptr, h.cluster_ptr, h.title_ptr or NONE64, h.mime_ptr + (64 << 10), self.source.size))
        raw = self.source.read(h.mime_ptr, max(0, end - h.mime_ptr))
        stop = raw.find(b"\0\0")
        self.mimes = [m.decode("utf-8", "replace") for m in (raw if stop < 0 else raw[:stop]).split(b"\0") if m]
        self.name = os.path.basename(source) if isinstance(source, str) else os.path.basename(source[0][0]) if isinstance(source, list) and source else ""

    def entry(self, idx: int) -> tuple:
        if not 0 <= idx < self.header.entry_count:
            raise ZimError(f"entry {idx} of {self.header.entry_count}")
        return next(iter(self.entries(idx, idx + 1)))

    def lower_bound(self, ns: str, path: str = "") -> int:
        """How many entries sort before (ns, path): entries are in order of namespace and path bytes."""
        key = ns.encode("latin-1"), path.encode("utf-8", "surrogateescape")
        return bisect_left(range(self.header.entry_count), key, key=lambda i: (lambda e: (e[2].encode("latin-1"), e[3].encode("utf-8", "surrogateescape")))(self.entry(i)))

    def find(self, ns: str, path: str) -> tuple | None:
        i = self.lower_bound(ns, path)
        e = self.entry(i) if i < self.header.entry_count else None
        return e if e is not None and (e[2], e[3]) == (ns, path) else None

    def namespace_range(self, ns: str) -> tuple[int, int]:
        lo = self.lower_bound(ns)
        return lo, self.lower_bound(chr(ord(ns) + 1)) if ord(ns) < 255 else self.header.entry_count

    def namespaces(self) -> list[str]:
        out, at = [], 0
        while at < self.header.entry_count:
            out.append(self.entry(at)[2])
            at = self.namespace_range(out[-1])[1]
        return out

    def main_entry(self) -> tuple | None:
        """`W/mainPage`, else the page that the header names; redirects are not followed."""
        found = self.find("W", "mainPage")
        return found if found is not None or self.header.main_page is None else self.entry(self.header.main_page)

    def resolve(self, entry: tuple | None, hops: int = 49) -> tuple | None:
        """The item at the end of an entry's redirects; an error where there are more than `hops`."""
        for _ in range(hops + 1):
            if entry is None or entry[5] != "redirect":
                return entry
            entry = self.entry(entry[9])
        raise ZimError("too many redirects")

    def title_order(self) -> list[int]:
        """Entry numbers in order of title: the stored listing of articles, else the header's title list, else none."""
        for version in ("v1", "v0"):
            e = self.find("X", f"listing/titleOrdered/{version}")
            if e is not None and e[5] == "item":
                data = self.content(e)
                return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))
        h = self.header
        return list(struct.unpack(f"<{h.entry_count}I", self.source.read(h.title_ptr, 4 * h.entry_count))) if h.title_ptr is not None else []

    def index_entry(self, kind: str) -> tuple | None:
        """The entry of the embedded `fulltext` or `title` index, in the new place or, for full text, in the old one."""
        found = self.find("X", f"{kind}/xapian")
        return found if found is not None or kind != "fulltext" else self.find("Z", "/fulltextIndex/xapian")

    def index_ranges(self, kind: str) -> list[tuple] | None:
        """Where the embedded index lies in the archive's files: null without one, or where it is stored compressed."""
        e = self.resolve(self.index_entry(kind))
        return self.direct_access(e[7], e[8]) if e is not None and e[5] == "item" else None

    def content(self, entry: tuple) -> bytes:
        if entry[5] != "item":
            raise ZimError(f"{entry[3]} is a {entry[5]}")
        blobs = self.cluster(entry[7])
        if entry[8] >= len(blobs):
            raise ZimError(f"blob {entry[8]} of {len(blobs)}")
        return blobs[entry[8]]

    def direct_access(self, cluster: int, blob: int) -> list[tuple] | None:
        """(file, offset, length) of a blob, to be read without this class; null where its cluster is compressed."""
        start = self.pointers(self.header.cluster_ptr, cluster, cluster + 1)[0]
        info = self.source.read(start, 1)[0]
        if info & 0x0F not in (0, 1):
            return None
        width = 8 if info & 0x10 else 4
        a, z = struct.unpack("<QQ" if width == 8 else "<II", self.source.read(start + 1 + blob * width, 2 * width))
        if z < a:
            raise ZimError("offsets not ascending")
        return self.source.ranges(start + 1 + a, z - a)

    def pointers(self, at: int, lo: int, hi: int) -> list[int]:
        return list(struct.unpack(f"<{hi - lo}Q", self.source.read(at + 8 * lo, 8 * (hi - lo))))

    def entries(self, lo: int, hi: int) -> Iterator[tuple]:
        for idx, at in enumerate(self.pointers(self.header.path_ptr, lo, hi), lo):
            yield self._entry(idx, at)

    def _entry(self, idx: int, at: int) -> tuple:
        for window in (2 << 10, 64 << 10, 132 << 10):
            data = self.source.read(at, min(window, max(0, self.source.size - at)))
            if len(data) < 12:
                raise ZimError("entry outside the file")
            mime, _, ns, _ = struct.unpack_from("<HBBI", data)
            start = 12 if mime == REDIRECT else 16
            stop = data.find(b"\0", start)
            last = data.find(b"\0", stop + 1) if stop >= 0 else -1
            if last >= 0:
                break
        else:
            raise ZimError("path or title without an end")
        path, title = data[start:stop].decode("utf-8", "replace"), data[stop + 1 : last].decode("utf-8", "replace")
        kind = {REDIRECT: "redirect", LINKTARGET: "linktarget", DELETED: "deleted"}.get(mime, "item")
        cluster = blob = target = name = None
        if kind == "item":
            cluster, blob = struct.unpack_from("<II", data, 8)
            name = self.mimes[mime] if mime < len(self.mimes) else None
        elif kind == "redirect":
            target = struct.unpack_from("<I", data, 8)[0]
        return self.name, idx, chr(ns), path, title, kind, name, cluster, blob, target

    def cluster(self, k: int) -> list[bytes]:
        start = self.pointers(self.header.cluster_ptr, k, k + 1)[0]
        return decode_cluster(self.source.read(start, self._next_start(start) - start), self.header.entry_count)

    def _next_start(self, start: int) -> int:
        """Where the cluster at `start` ends at the latest: clusters may be stored in any order, so the next greater pointer counts."""
        if not hasattr(self, "_starts"):
            self._starts = sorted(self.pointers(self.header.cluster_ptr, 0, self.header.cluster_count))
        at = bisect_right(self._starts, start)
        return self._starts[at] if at < len(self._starts) else (self.header.checksum_ptr or self.source.size)

    def checksum_ok(self) -> bool | None:
        """None where the archive has no checksum."""
        at = self.header.checksum_ptr
        if at is None:
            return None
        digest, k = hashlib.md5(), 0
        while k < at:
            digest.update(self.source.read(k, min(1 << 20, at - k)))
            k += min(1 << 20, at - k)
        return digest.digest() == self.source.read(at, 16)


def discover(folders: list[str], recursive: bool = True) -> list[str]:
    """Archives below the folders: *.zim and first parts, whatever the case, sorted, each once."""
    found = set()
    for folder in folders:
        for base, dirs, names in os.walk(folder, followlinks=True):
            found |= {os.path.join(base, n) for n in names if n.lower().endswith((".zim", ".zimaa"))}
            if not recursive:
                dirs.clear()
    return sorted(found)


def labels(paths: list[str]) -> dict[str, str]:
    """What archives are called in the tables: by file name, by whole path where several have one name."""
    n = Counter(map(os.path.basename, paths))
    return {p: os.path.basename(p) if n[os.path.basename(p)] == 1 else p for p in paths}


#: Up to so many archives are planned by their headers, a range of entries a task. Of more, those up to WHOLE bytes are dealt whole,
#: up to PACK bytes a task, and are planned where they are read, so neither tasks nor the driver's work grow with their number.
PLANNED, WHOLE, PACK, LEAST = 256, 16 << 20, 64 << 20, 96


def packs(paths: list[str]) -> tuple[list[str], list[list[str]]]:
    """The archives to be planned one by one, and the others dealt into groups of about equal size."""
    if len(paths) <= PLANNED:
        return paths, []
    sizes = [Bytes(p).size for p in paths]
    cost = lambda n: n + 4096  # to open an archive costs something as well
    most = min(PACK, sum(cost(n) for n in sizes if n <= WHOLE) // LEAST + 1)
    out, room = [], 0
    for p, n in zip(paths, sizes, strict=True):
        if n <= WHOLE:
            if room <= 0:
                out.append([])
                room = most
            out[-1].append(p)
            room -= cost(n)
    return [p for p, n in zip(paths, sizes, strict=True) if n > WHOLE], out


@dataclass
class Range(InputPartition):
    path: str
    label: str
    lo: int
    hi: int


@dataclass
class Pack(InputPartition):
    files: list[tuple[str, str]]  # with their labels


class Slim:
    """A reader that goes to tasks without what names every archive: that would grow with the square of their number."""

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("paths", "labels")}


class ZimReader(Slim, DataSourceReader):
    """Plans by headers. Filters on ns narrow the entries read, filters on cluster the clusters decoded."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.table = options.get("table", "entries")
        self.offset, self.length = int(options.get("offset", 0)), int(options["length"]) if "length" in options else None
        self.step = int(options.get("rows", 64 if self.table == "blobs" else 100_000))
        self.labels = labels(self.paths)
        self.spaces: set[str] | None = None
        self.lo, self.hi, self.chosen = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if self.table == "entries" and name == "ns" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.spaces = own if self.spaces is None else self.spaces & own
            elif self.table == "blobs" and name == "cluster" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chosen = own if self.chosen is None else self.chosen & own
            elif self.table == "blobs" and name == "cluster" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            elif self.table == "blobs" and name == "cluster" and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value + isinstance(f, LessThanOrEqual)
                self.hi = top if self.hi is None else min(self.hi, top)
            else:
                yield f

    def _wanted(self, a: Archive) -> list[tuple[int, int]]:
        if self.table == "titles":
            return [(0, len(a.title_order()))]
        if self.table == "entries":
            if self.spaces is None:
                return [(0, a.header.entry_count)]
            return [a.namespace_range(ns) for ns in sorted(self.spaces) if len(ns) == 1 and ord(ns) < 256]
        n = a.header.cluster_count
        hi = n if self.hi is None else min(n, max(self.hi, 0))
        if self.chosen is None:
            return [(self.lo, hi)]
        return [(k, k + 1) for k in sorted(self.chosen) if k is not None and self.lo <= k < hi]

    def partitions(self) -> list[Range | Pack]:
        planned, rest = packs(self.paths) if self.offset == 0 and self.length is None else (self.paths, [])
        out: list[Range | Pack] = [Pack([(p, self.labels[p]) for p in own]) for own in rest]
        for p in planned:
            for lo, hi in self._wanted(Archive(p, self.offset, self.length)):
                out += [Range(p, self.labels[p], k, min(hi, k + self.step)) for k in range(lo, hi, self.step)]
        return out

    def read(self, part: Range | Pack) -> Iterator[tuple]:
        for path, label in part.files if isinstance(part, Pack) else [(part.path, part.label)]:
            a = Archive(path, self.offset, self.length)
            a.name = label
            for lo, hi in self._wanted(a) if isinstance(part, Pack) else [(part.lo, part.hi)]:
                yield from self._rows(a, lo, hi)

    def _rows(self, a: Archive, lo: int, hi: int) -> Iterator[tuple]:
        if self.table == "entries":
            yield from a.entries(lo, hi)
        elif self.table == "titles":
            for position, idx in enumerate(a.title_order()[lo:hi], lo):
                yield a.name, position, idx
        else:
            for k in range(lo, hi):
                for i, content in enumerate(a.cluster(k)):
                    yield a.name, k, i, len(content), content


class ZimSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zim"

    def schema(self) -> str:
        return {"entries": ENTRIES, "blobs": BLOBS, "titles": TITLES}[self.options.get("table", "entries")]

    def reader(self, schema) -> ZimReader:
        return ZimReader(dict(self.options))


def register(spark) -> None:
    """Makes the format known to the session, and lets it push filters down to the reader."""
    spark.dataSource.register(ZimSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
