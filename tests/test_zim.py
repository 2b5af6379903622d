import lzma
import struct

import pytest

from quarry.sources import writing, zim


def build(entries, codec=0, extended=False):
    return writing.archive(entries, codec, extended)


ROWS = [("C", "Apple", "Apple", b"<p>a"), ("C", "Apple_pie", "Apple pie", b"<p>pie"), ("C", "Apples", "Apples", "Apple"), ("C", "zebra", "zebra", b""), ("M", "Title", "Title", b"Sample")]


@pytest.mark.parametrize("codec", [0, 4, 5])
@pytest.mark.parametrize("extended", [False, True])
def test_round_trip(spark, tmp_path, codec, extended):
    (tmp_path / "a.zim").write_bytes(build(ROWS, codec, extended))
    zim.register(spark)
    read = spark.read.format("zim").option("path", str(tmp_path / "a.zim")).option("rows", 2)
    entries = read.load().orderBy("idx").collect()
    assert [(e.ns, e.path, e.title or e.path) for e in entries] == [r[:3] for r in ROWS]
    assert [e.kind for e in entries] == ["item", "item", "redirect", "item", "item"] and entries[2].redirect_idx == 0
    blobs = {(b.cluster, b.blob): bytes(b.content) for b in read.option("table", "blobs").load().collect()}
    assert [blobs[e.cluster, e.blob] for e in entries if e.kind == "item"] == [r[3] for r in ROWS if isinstance(r[3], bytes)]
    assert zim.Archive(str(tmp_path / "a.zim")).checksum_ok()


def test_split_and_embedded(tmp_path):
    data = build(ROWS, 5)
    for k, end in enumerate("abc"):
        (tmp_path / f"s.zima{end}").write_bytes(data[k * 150 : (k + 1) * 150 if k < 2 else None])
    (tmp_path / "box").write_bytes(b"x" * 33 + data + b"y")
    (tmp_path / "a.ZIM").write_bytes(data)
    want = [r[1:] for r in zim.Archive(str(tmp_path / "a.ZIM")).entries(0, 5)]
    assert [r[1:] for r in zim.Archive(str(tmp_path / "s.zimaa")).entries(0, 5)] == want
    assert [r[1:] for r in zim.Archive(str(tmp_path / "box"), 33, len(data)).entries(0, 5)] == want
    assert [p.rsplit("/", 1)[1] for p in zim.discover([str(tmp_path), str(tmp_path)])] == ["a.ZIM", "s.zimaa"]


def test_corruptions(tmp_path):
    good = build(ROWS)
    for at, new in ((0, b"\0"), (4, b"\x09"), (32, b"\xff" * 8), (48, b"\xff" * 8), (56, b"\x07"), (72, b"\0" * 8)):
        (tmp_path / "bad.zim").write_bytes(good[:at] + new + good[at + len(new) :])
        with pytest.raises(zim.ZimError):
            zim.Archive(str(tmp_path / "bad.zim"))
    flipped = bytearray(good)
    flipped[-20] ^= 1
    (tmp_path / "bad.zim").write_bytes(flipped)
    assert zim.Archive(str(tmp_path / "bad.zim")).checksum_ok() is False
    for data in (b"\x02abcd", b"\x00\x07\0\0\0", b"\x00\x08\0\0\0\x04\0\0\0", b"\x00"):
        with pytest.raises(zim.ZimError):
            zim.decode_cluster(data, 9)


def test_sources(tmp_path):
    """In memory, and as a list of ranges of files."""
    data = build(ROWS, 5)
    want = [r[1:] for r in zim.Archive(data).entries(0, 5)]
    (tmp_path / "x").write_bytes(b"??" + data[:100] + b"!")
    (tmp_path / "y").write_bytes(data[100:])
    ranges = [(str(tmp_path / "x"), 2, 100), (str(tmp_path / "y"), 0, len(data) - 100)]
    assert [r[1:] for r in zim.Archive(ranges).entries(0, 5)] == want
    with pytest.raises(zim.ZimError):
        zim.Bytes([(str(tmp_path / "x"), 2, 1000)])
    b = zim.Bytes(b"abcdef", 2)
    assert b.read(1, 2) == b"de" and b.size == 4
    with pytest.raises(zim.ZimError):
        b.read(3, 2)


def test_lookups():
    rows = [*ROWS, ("W", "mainPage", "", "C/Apple"), ("X", "listing/titleOrdered/v1", "", b"\x03\0\0\0\0\0\0\0")]
    rows = [r for r in rows if r[0] != "W"]
    a = zim.Archive(build(rows, 0))
    assert a.namespaces() == ["C", "M", "X"] and a.namespace_range("M") == (4, 5) and a.namespace_range("D") == (4, 4)
    assert a.find("C", "Apples")[1] == 2 and a.find("C", "Appl") is None and a.lower_bound("C", "Apple_") == 1 and a.lower_bound("Z") == 6
    assert a.resolve(a.find("C", "Apples"))[3] == "Apple" and a.content(a.find("M", "Title")) == b"Sample"
    assert a.title_order() == [3, 0] and a.main_entry()[3] == "Apple"
    e = a.find("C", "Apple_pie")
    ((source, at, n),) = a.direct_access(e[7], e[8])
    assert source[at : at + n] == b"<p>pie" and zim.Archive(build(rows, 4)).direct_access(e[7], e[8]) is None
    for bad in (lambda: a.entry(99), lambda: a.content(a.find("C", "Apples"))):
        with pytest.raises(zim.ZimError):
            bad()


def test_clusters_in_any_order():
    data = bytearray(build([("C", f"p{k}", "", bytes([65 + k]) * 40) for k in range(6)], 0))
    at = struct.unpack_from("<Q", data, 48)[0]
    first, second = struct.unpack_from("<QQ", data, at)
    struct.pack_into("<QQ", data, at, second, first)
    a = zim.Archive(bytes(data))
    assert a.cluster(0)[0][:1] == b"C" and a.cluster(1)[0][:1] == b"A" and a.cluster(2)[0][:1] == b"E"
    assert a._next_start(first) == second


def test_pushed_filters(spark, tmp_path):
    (tmp_path / "a.zim").write_bytes(build([*ROWS, ("X", "listing/titleOrdered/v1", "", b"\x03\0\0\0\0\0\0\0")], 5))
    zim.register(spark)
    read = spark.read.format("zim").option("path", str(tmp_path / "a.zim"))
    assert [e.idx for e in read.load().filter("ns = 'M'").collect()] == [4]
    assert sorted(e.ns for e in read.load().filter("ns in ('C', 'X') and idx > 1").collect()) == ["C", "C", "X"]
    blobs = read.option("table", "blobs").load()
    assert {b.cluster for b in blobs.filter("cluster = 1").collect()} == {1} and {b.cluster for b in blobs.filter("cluster >= 1 and cluster < 2").collect()} == {1}
    assert [(t.position, t.idx) for t in read.option("table", "titles").load().orderBy("position").collect()] == [(0, 3), (1, 0)]
    r = zim.ZimReader({"path": str(tmp_path / "a.zim")})
    from pyspark.sql.datasource import EqualTo

    assert list(r.pushFilters([EqualTo(("ns",), "M")])) == [] and [(p.lo, p.hi) for p in r.partitions()] == [(4, 5)]


def test_xz_clusters_are_read_with_little_memory():
    text = b"quay mole pier " * 1000
    a = zim.Archive(writing.archive([("C", "p", "", text)], writing.XZ))
    start, end = a.pointers(a.header.cluster_ptr, 0, 1)[0], a.header.checksum_ptr
    assert a.cluster(0) == [text]
    assert lzma.LZMADecompressor(memlimit=4 << 20).decompress(a.source.read(start + 1, end - start - 1)).endswith(text)
