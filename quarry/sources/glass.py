"""Glass databases (the index format inside archives) as DataFrames: B-tree blocks are decoded on the executors, a subtree a task.

    spark.dataSource.register(GlassSource)
    spark.read.format("glass").option("path", "/books/a.zim").option("index", "fulltext").option("table", "postings").load()

`path` names archives with an uncompressed index (`index`: fulltext or title), or database files of their own. Tables, each with
the archive first: terms (term, term_freq, coll_freq), postings (term, docid, wdf), lengths (docid, doclen), documents (docid, data),
positions (term, docid, positions), values (slot, docid, value), value_stats (slot, freq, lower, upper), metadata (key, value).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources import zim

# Fixed values of the format.
MAGIC, VERSION = b"\x0f\x0dXapian Glass", 0x046E
TABLES = ["postlist", "docdata", "termlist", "position", "spelling", "synonym"]
COMPRESSED, LAST, FIRST, SIZE = 0x80, 0x40, 0x20, 0x1FFF
DIRECTORY = 11
META, SLOT_STATS, SLOT, LENGTHS = b"\0\xc0", b"\0\xd0", b"\0\xd8", b"\0\xe0"
SCHEMAS = {
    "terms": "archive string, term binary, term_freq long, coll_freq long",
    "postings": "archive string, term binary, docid long, wdf long",
    "lengths": "archive string, docid long, doclen long",
    "documents": "archive string, docid long, data binary",
    "positions": "archive string, term binary, docid long, positions array<long>",
    "values": "archive string, slot long, docid long, value binary",
    "value_stats": "archive string, slot long, freq long, lower binary, upper binary",
    "metadata": "archive string, key string, value binary",
}
_TREE = {"documents": "docdata", "positions": "position"}


class GlassError(ValueError):
    """The bytes are no valid database."""


class Packed:
    """Values packed one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __bool__(self) -> bool:
        return self.at < len(self.data)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise GlassError("packed value runs past the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """Seven bits a byte, the lowest first."""
        value = shift = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if value >> 64:
                raise GlassError("number over 64 bits")
            if b < 0x80:
                return value
            shift += 7

    def flag(self) -> bool:
        b = self.take(1)
        if b not in (b"0", b"1"):
            raise GlassError("bad flag")
        return b == b"1"

    def text(self) -> bytes:
        return self.take(self.number())

    def ordered_number(self) -> int:
        """A number whose bytes sort as it does: two bytes, or as many more as the first has leading ones."""
        head = self.take(1)[0]
        if head < 0x80:
            return head << 8 | self.take(1)[0]
        ones = 8 - (head ^ 0xFF).bit_length()
        if ones > 7:
            raise GlassError("bad ordered number")
        return int.from_bytes(bytes([head & (0x7F >> ones)]) + self.take(ones + 1), "big")

    def ordered_text(self) -> tuple[bytes, bool]:
        """A text whose zero bytes are escaped, and whether an end mark follows it."""
        out = bytearray()
        while self:
            b = self.take(1)
            if b == b"\0":
                if self.data[self.at : self.at + 1] != b"\xff":
                    return bytes(out), True
                self.at += 1
            out += b
        return bytes(out), False


#: The numbers of up to two bytes, packed: nearly all that an index holds.
_PACKED = [bytes([n]) if n < 0x80 else bytes([n & 0x7F | 0x80, n >> 7]) for n in range(1 << 14)]


def pack_number(n: int) -> bytes:
    if 0 <= n < 1 << 14:
        return _PACKED[n]
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def pack_ordered_number(n: int) -> bytes:
    if n < 0x8000:
        return n.to_bytes(2, "big")
    size = 3  # with `size` bytes 7 * size + 1 bits fit beside the marks
    while n >> (7 * size + 1):
        size += 1
    return (n | (0xFF << (10 - size) & 0xFF) << 8 * (size - 1)).to_bytes(size, "big")


def pack_ordered_text(t: bytes, end: bool = True) -> bytes:
    return t.replace(b"\0", b"\0\xff") + b"\0" * end


@dataclass(frozen=True)
class Root:
    block: int
    level: int
    empty: bool
    entries: int
    block_size: int


@dataclass(frozen=True)
class Header:
    revision: int
    roots: dict[str, Root]
    stats: dict[str, int]


def parse_header(data: bytes) -> Header:
    if data[:14] != MAGIC or len(data) < 33:
        raise GlassError("wrong magic number")
    if int.from_bytes(data[14:16], "big") != VERSION:
        raise GlassError("unknown version")
    p = Packed(data[:4096], 32)
    revision, roots = p.number(), {}
    for name in TABLES:
        block, shape, entries, size, _, _ = p.number(), p.number(), p.number(), p.number() << 11, p.number(), p.text()
        if shape >> 2 >= 10 or shape & 1 and shape >> 2 or size not in (2048, 4096, 8192, 16384, 32768, 65536):
            raise GlassError(f"bad root of {name}")
        roots[name] = Root(block, shape >> 2, bool(shape & 1), entries, size)
    names = ["doc_count", "last_docid", "doclen_lower", "wdf_upper", "doclen_upper", "oldest_changeset", "total_doclen", "spelling_upper"]
    stats = {n: p.number() for n in names}
    stats["last_docid"] += stats["doc_count"]  # two are stored as differences
    stats["doclen_upper"] += stats["wdf_upper"]
    return Header(revision, roots, stats)


@dataclass(frozen=True)
class Item:
    key: bytes
    part: int
    flags: int
    body: bytes


class Tree:
    """One table: entries (key, tag) in order of key. A tag may be cut into parts and be compressed."""

    def __init__(self, source: zim.Bytes, root: Root):
        self.source, self.root = source, root

    def _block(self, n: int, level: int) -> tuple[bytes, list[int]]:
        size = self.root.block_size
        if (n + 1) * size > self.source.size:
            raise GlassError(f"block {n} outside the database")
        b = self.source.read(n * size, size)
        end = int.from_bytes(b[9:11], "big")
        if b[4] != level:
            raise GlassError(f"block {n} is of level {b[4]}, not {level}")
        if not DIRECTORY <= end <= size or (end - DIRECTORY) % 2:
            raise GlassError(f"block {n} has a bad directory")
        return b, [int.from_bytes(b[i : i + 2], "big") for i in range(DIRECTORY, end, 2)]

    def items(self, n: int) -> list[Item]:
        b, places = self._block(n, 0)
        out = []
        for at in places:
            head = int.from_bytes(b[at : at + 2], "big")
            data = b[at : at + (head & SIZE) + 3]
            body = 3 + (data[2] if len(data) > 2 else 0) + (0 if head >> 8 & FIRST else 2)
            if len(data) != (head & SIZE) + 3 or body > len(data):
                raise GlassError(f"item outside block {n}")
            key = data[3 : 3 + data[2]]
            out.append(Item(key, 1 if head >> 8 & FIRST else int.from_bytes(data[body - 2 : body], "big"), head >> 8, data[body:]))
        return out

    def children(self, n: int, level: int) -> list[tuple[bytes, int, int]]:
        """(key, part, block) of a branch's children; each holds what is not less than its key, and the first whatever comes before."""
        b, places = self._block(n, level)
        out = []
        for at in places:
            k = at + 5 + (b[at + 4] if at + 4 < len(b) else 0)
            if k + 2 > len(b):
                raise GlassError(f"item outside block {n}")
            out.append((b[at + 5 : k], int.from_bytes(b[k : k + 2], "big"), int.from_bytes(b[at : at + 4], "big")))
        return out

    def walk(self, start: bytes = b"", n: int | None = None, level: int | None = None) -> Iterator[Item]:
        """Items from the first with a key of `start` or more, below one block."""
        if self.root.empty:
            return
        n, level = (self.root.block, self.root.level) if n is None else (n, level)
        if level == 0:
            yield from (i for i in self.items(n) if i.key >= start)
            return
        below = self.children(n, level)
        first = max(0, bisect_right([c[:2] for c in below], (start, 1)) - 1)
        for k, (_, _, child) in enumerate(below[first:]):
            yield from self.walk(b"" if k else start, child, level - 1)

    def entries(self, items: Iterator[Item]) -> Iterator[tuple[bytes, bytes]]:
        """(key, tag) of the entries whose first part is among the items."""
        parts: list[bytes] = []
        key = None
        for i in items:
            if i.flags & FIRST:
                if parts:
                    raise GlassError("tag without a last part")
                key = i.key
            elif key is None:
                continue  # the rest of an entry that begins before the range
            parts.append(i.body)
            if i.flags & LAST:
                whole = b"".join(parts)
                try:
                    yield key, zlib.decompress(whole, wbits=-15) if i.flags & COMPRESSED else whole
                except zlib.error as e:
                    raise GlassError(f"tag does not inflate: {e}") from e
                key, parts = None, []
        if parts:
            raise GlassError("tag without a last part")

    def scan(self, start: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
        return self.entries(self.walk(start))

    def get(self, key: bytes) -> bytes | None:
        found = next(self.scan(key[:255]), None)
        return found[1] if found is not None and found[0] == key else None

    def floor(self, key: bytes) -> tuple[bytes, bytes] | None:
        """The last entry whose key is not greater."""

        def last(n: int, level: int) -> bytes | None:
            if level == 0:
                return max((i.key for i in self.items(n) if i.key <= key), default=None)
            below = self.children(n, level)
            for k in range(bisect_right([c[:2] for c in below], (key, 0xFFFF)) - 1, -1, -1):
                found = last(below[k][2], level - 1)
                if found is not None:
                    return found
            return last(below[0][2], level - 1)

        found = None if self.root.empty else last(self.root.block, self.root.level)
        return None if found is None else (found, self.get(found))

    def ranges(self) -> list[tuple[int, int, list[int]]]:
        """Disjoint subtrees in order: (block, level, the subtrees' blocks that follow it)."""
        if self.root.empty:
            return []
        tops = [(self.root.block, self.root.level)]
        while len(tops) < 64 and tops[0][1] > 1:
            tops = [(c, level - 1) for n, level in tops for _, _, c in self.children(n, level)]
        return [(n, level, [m for m, _ in tops[k + 1 : k + 33]]) for k, (n, level) in enumerate(tops)]

    def subtree(self, n: int, level: int, after: list[int]) -> Iterator[tuple[bytes, bytes]]:
        """The entries that begin in a subtree; the last may end in those that follow."""

        def items() -> Iterator[Item]:
            done = True
            for i in self.walk(b"", n, level):
                done = bool(i.flags & LAST)
                yield i
            for m in after:
                for i in self.walk(b"", m, level):
                    if done or i.flags & FIRST:
                        return
                    done = bool(i.flags & LAST)
                    yield i

        return self.entries(items())


def posting_key(term: bytes, docid: int | None = None) -> bytes:
    head = pack_ordered_text(term, docid is not None) if term else LENGTHS
    return head + (b"" if docid is None else pack_ordered_number(docid))


def parse_posting_key(key: bytes) -> tuple[bytes, int | None] | None:
    """(term, first docid of a later chunk); the term of document lengths is empty; null for keys of other things."""
    p = Packed(key, 2 if key.startswith(LENGTHS) else 0)
    if key[:1] == b"\0" and key[1:2] != b"\xff":  # a term may begin with an escaped zero
        if not p.at:
            return None
        return b"", p.ordered_number() if p else None
    term, ended = p.ordered_text()
    return term, p.ordered_number() if ended and p else None


def chunk(docid: int | None, tag: bytes) -> tuple[tuple[int, int] | None, list[tuple[int, int]]]:
    """A chunk of a posting list: (term_freq, coll_freq) in the first one, and its (docid, wdf)."""
    p, freqs = Packed(tag), None
    if docid is None:
        freqs = p.number(), p.number()
        docid = p.number() + 1
    p.flag()
    last = docid + p.number()
    out = [(docid, p.number())]
    while p:
        docid += p.number() + 1
        out.append((docid, p.number()))
    if docid != last:
        raise GlassError("chunk ends before its last document")
    return freqs, out


class _Bits:
    """Bits of a byte string, the lowest first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "little"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise GlassError("bits end too early")
        out = self.value & (1 << n) - 1
        self.value >>= n
        self.left -= n
        return out

    def below(self, n: int) -> int:
        """A number under n in a truncated binary code, whose middle values are a bit shorter."""
        bits = (n - 1).bit_length()
        spare = (1 << bits) - n
        if not spare:
            return self.take(bits)
        short = self.take(bits - 1)
        return short + (n + spare) // 2 if short < (n - spare) // 2 and self.take(1) else short


def decode_positions(data: bytes) -> list[int]:
    """Ascending positions: the last one, then in bits the first, the number, and middles between known neighbours."""
    if not data:
        return []
    p = Packed(data)
    last = p.number()
    if not p:
        return [last]
    bits = _Bits(data[p.at :])
    if last < 1:
        raise GlassError("bad positions")
    first = bits.below(last)
    size = bits.below(last - first) + 2
    if size > 1 << 24:
        raise GlassError("too many positions")
    out = [first, *[0] * (size - 2), last]
    waiting = [(0, size - 1)]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < 2:
            continue
        mid = lo + (hi - lo) // 2
        room = out[hi] - out[lo] + 1 - (hi - lo)
        if room < 1:
            raise GlassError("positions do not ascend")
        out[mid] = bits.below(room) + out[lo] + mid - lo
        waiting += [(mid, hi), (lo, mid)]  # the left half comes first
    return out


def parse_value_key(key: bytes) -> tuple[int, int]:
    p = Packed(key, 2)
    return p.number(), p.ordered_number()


def value_chunk(docid: int, tag: bytes) -> list[tuple[int, bytes]]:
    p = Packed(tag)
    out = [(docid, p.text())]
    while p:
        docid += p.number() + 1
        out.append((docid, p.text()))
    return out


class Database:
    """Point lookups in one database."""

    def __init__(self, source: str | bytes | list[tuple[str, int, int]], offset: int = 0, length: int | None = None):
        self.source = source if isinstance(source, zim.Bytes) else zim.Bytes(source, offset, length)
        self.header = parse_header(self.source.read(0, min(4096, self.source.size)))
        self.stats = self.header.stats

    def tree(self, name: str) -> Tree:
        return Tree(self.source, self.header.roots[name])

    def has(self, name: str) -> bool:
        return not self.header.roots[name].empty

    def metadata(self, key: str) -> bytes | None:
        return self.tree("postlist").get(META + key.encode())

    def value_slots(self) -> dict[str, int]:
        """Names of value slots, as the archives' makers record them."""
        pairs = (x.partition(":") for x in (self.metadata("valuesmap") or b"").decode("utf-8", "replace").split(";"))
        return {name.strip(): int(slot) for name, _, slot in pairs if slot.strip().isdigit()}

    def postings(self, term: bytes) -> Iterator[tuple[int, int]]:
        for key, tag in self.tree("postlist").scan(posting_key(term)):
            found = parse_posting_key(key)
            if found is None or found[0] != term:
                return
            yield from chunk(found[1], tag)[1]

    def frequencies(self, term: bytes) -> tuple[int, int] | None:
        tag = self.tree("postlist").get(posting_key(term))
        return chunk(None, tag)[0] if tag is not None else None

    def wdf(self, term: bytes, docid: int) -> int | None:
        """How often a document has the term (for the empty term, its length): the chunk with the last first docid that is not greater."""
        found = self.tree("postlist").floor(posting_key(term, docid))
        parsed = parse_posting_key(found[0]) if found else None
        if parsed is None or parsed[0] != term:
            return None
        return dict(chunk(parsed[1], found[1])[1]).get(docid)

    def data(self, docid: int) -> bytes | None:
        return self.tree("docdata").get(pack_ordered_number(docid))

    def value(self, docid: int, slot: int) -> bytes | None:
        """As of the chunk with the last first docid that is not greater."""
        found = self.tree("postlist").floor(SLOT + pack_number(slot) + pack_ordered_number(docid))
        if found is None or not found[0].startswith(SLOT):
            return None
        own, first = parse_value_key(found[0])
        return dict(value_chunk(first, found[1])).get(docid) if own == slot else None

    def positions(self, term: bytes, docid: int) -> list[int]:
        return decode_positions(self.tree("position").get(pack_ordered_text(term) + pack_ordered_number(docid)) or b"")


def rows(table: str, entries: Iterator[tuple[bytes, bytes]]) -> Iterator[tuple]:
    """The rows of a table of SCHEMAS that come from some entries of its tree."""
    for key, tag in entries:
        if table == "documents":
            yield Packed(key).ordered_number(), tag
        elif table == "positions":
            p = Packed(key)
            yield p.ordered_text()[0], p.ordered_number(), decode_positions(tag)
        elif key.startswith(META):
            if table == "metadata":
                yield key[2:].decode("utf-8", "replace"), tag
        elif key.startswith(SLOT_STATS):
            if table == "value_stats":
                p = Packed(tag)
                freq, lower = p.number(), p.text()
                yield int.from_bytes(key[2:], "little"), freq, lower, tag[p.at :] or lower
        elif key.startswith(SLOT):
            if table == "values":
                slot, first = parse_value_key(key)
                yield from ((slot, d, v) for d, v in value_chunk(first, tag))
        elif table in ("terms", "postings", "lengths") and (found := parse_posting_key(key)) is not None:
            term, first = found
            if bool(term) == (table == "lengths"):
                continue
            freqs, posts = chunk(first, tag)
            if table == "terms":
                yield from [(term, *freqs)] if freqs else []
            elif table == "lengths":
                yield from posts
            else:
                yield from ((term, d, n) for d, n in posts)


@dataclass
class Subtree(InputPartition):
    path: str
    label: str
    block: int
    level: int
    after: list[int]


class GlassReader(zim.Slim, DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.index, self.table = [p for p in options["path"].split(",") if p], options.get("index"), options.get("table", "postings")
        self.offset, self.length = int(options.get("offset", 0)), int(options["length"]) if "length" in options else None
        self.labels = zim.labels(self.paths)

    def _tree(self, path: str) -> Tree:
        name = _TREE.get(self.table, "postlist")
        if not self.index:
            return Database(path, self.offset, self.length).tree(name)
        where = zim.Archive(path, self.offset, self.length).index_ranges(self.index)
        if where is None:
            raise GlassError(f"{path} has no {self.index} index that is stored uncompressed")
        return Database(where).tree(name)

    def partitions(self) -> list[Subtree | zim.Pack]:
        planned, rest = zim.packs(self.paths) if self.offset == 0 and self.length is None else (self.paths, [])
        trees = [Subtree(p, self.labels[p], *r) for p in planned for r in self._tree(p).ranges()]
        return [*trees, *(zim.Pack([(p, self.labels[p]) for p in own]) for own in rest)] or [Subtree("", "", -1, 0, [])]

    def read(self, part: Subtree | zim.Pack) -> Iterator[tuple]:
        if isinstance(part, zim.Pack):
            for path, label in part.files:
                for row in rows(self.table, self._tree(path).scan()):
                    yield label, *row
        elif part.path:
            for row in rows(self.table, self._tree(part.path).subtree(part.block, part.level, part.after)):
                yield part.label, *row


class GlassSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "glass"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "postings")]

    def reader(self, schema) -> GlassReader:
        return GlassReader(dict(self.options))
