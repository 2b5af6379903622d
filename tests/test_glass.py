import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.plans import registry
from quarry.sources import glass as G
from quarry.sources import writing, zim


def sample(n=400, seed=1):
    r = random.Random(seed)
    docs = r.sample(range(1, 100_000), n)
    words = [f"w{k}".encode() for k in range(300)] + [b"a\0b", b"\0", b"zz" * 60, "é".encode()]
    terms, positions = {}, {}
    for w in words:
        for d in r.sample(docs, r.choice([1, 3, 90])):
            terms.setdefault(w, []).append((d, r.randint(1, 300)))
            if r.random() < 0.1:
                positions[w, d] = sorted(r.sample(range(1, 5000), r.choice([1, 2, 3, 40])))
    data = {d: (f"C/page_{d}" * r.choice([1, 1, 400])).encode() for d in docs}
    values = {0: {d: f"Title {d}".encode() for d in docs}, 1: {d: b"7" for d in docs[:50]}, 300: {docs[0]: b""}}
    return terms, data, positions, values, {"valuesmap": b"title:0;wordcount:1;geo.position:300", "language": b"en"}


def all_of(db, table):
    tree = db.tree(G._TREE.get(table, "postlist"))
    return [r for part in tree.ranges() for r in G.rows(table, tree.subtree(*part))]


@pytest.fixture(scope="module", params=[2048, 8192])
def made(request):
    parts = sample()
    return parts, writing.database(*parts, block_size=request.param)


def test_scans(made):
    (terms, data, positions, values, meta), raw = made
    db = G.Database(raw)
    assert sorted(all_of(db, "postings")) == sorted((t, d, w) for t, p in terms.items() for d, w in p)
    assert sorted(all_of(db, "terms")) == sorted((t, len(p), sum(w for _, w in p)) for t, p in terms.items())
    assert [t for t, _, _ in all_of(db, "terms")] == sorted(terms)
    assert sorted(all_of(db, "documents")) == sorted(data.items())
    assert sorted(all_of(db, "positions")) == sorted((t, d, p) for (t, d), p in positions.items())
    assert sorted(all_of(db, "values")) == sorted((s, d, v) for s, own in values.items() for d, v in own.items())
    assert sorted(all_of(db, "value_stats")) == sorted((s, len(own), min(own.values()), max(own.values())) for s, own in values.items())
    assert dict(all_of(db, "metadata")) == meta
    lengths = dict(all_of(db, "lengths"))
    assert lengths.keys() == data.keys() and sum(lengths.values()) == db.stats["total_doclen"]
    assert db.stats["doc_count"] == len(data) and db.stats["last_docid"] == max(data) and db.stats["doclen_upper"] == max(lengths.values())
    assert db.header.revision == 7 and db.has("position") and not db.has("termlist")


def test_lookups(made):
    (terms, data, positions, values, meta), raw = made
    db = G.Database(raw)
    for t, posts in terms.items():
        assert list(db.postings(t)) == sorted(posts) and db.frequencies(t) == (len(posts), sum(w for _, w in posts))
    for (t, d), p in list(positions.items())[:50]:
        assert db.positions(t, d) == p
    for d in list(data)[:60]:
        assert db.data(d) == data[d] and db.value(d, 0) == values[0][d] and db.value(d, 1) == values[1].get(d) and db.value(d, 300) == values[300].get(d)
        t, posts = next(iter(terms.items()))
        assert db.wdf(t, d) == dict(posts).get(d)
        assert db.wdf(b"", d) == sum(w for p in terms.values() for x, w in p if x == d)
    assert list(db.postings(b"none")) == [] and db.frequencies(b"w") is None and db.data(99_999_999) is None and db.value(1, 7) is None
    assert db.value_slots() == {"title": 0, "wordcount": 1, "geo.position": 300} and db.metadata("none") is None and db.metadata("language") == b"en"


def test_empty_tables():
    db = G.Database(writing.database({}, {}))
    assert not db.has("position") and all_of(db, "positions") == [] and list(db.postings(b"x")) == [] and db.data(1) is None and db.positions(b"x", 1) == []


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 100_000), min_size=1, max_size=60))
def test_positions_round_trip(xs):
    pos = sorted(xs)
    if pos not in ([0], [0, 1]):  # these have the bytes of an empty and of a shorter list
        assert G.decode_positions(writing.pack_positions(pos)) == pos


@settings(max_examples=300, deadline=None)
@given(st.integers(0, (1 << 56) - 1), st.integers(0, (1 << 56) - 1), st.binary(max_size=20))
def test_packed_values(a, b, t):
    x, y = G.pack_ordered_number(a), G.pack_ordered_number(b)
    assert G.Packed(x).ordered_number() == a and (x < y) == (a < b)
    assert G.Packed(G.pack_number(a)).number() == a
    assert G.Packed(G.pack_ordered_text(t) + x).ordered_text() == (t, True) and G.Packed(G.pack_ordered_text(t, False)).ordered_text() == (t, False)


def test_broken_bytes():
    raw = writing.database(*sample(100), block_size=2048)
    for bad in (b"", raw[:20], b"x" + raw[1:], raw[:14] + b"\0\0" + raw[16:]):
        with pytest.raises(G.GlassError):
            G.Database(bad)
    with pytest.raises(G.GlassError):
        all_of(G.Database(raw[: len(raw) // 2]), "documents")
    r = random.Random(3)
    for _ in range(60):  # any damage is an error or other rows, never anything else
        x = bytearray(raw)
        for _ in range(4):
            x[r.randrange(2048, len(x))] ^= 1 << r.randrange(8)
        for table in ("postings", "documents", "positions", "values"):
            try:
                all_of(G.Database(bytes(x)), table)
            except (G.GlassError, IndexError, OverflowError):
                pass
    for bad in (b"\x05", b"\x85"):
        with pytest.raises(G.GlassError):
            G.Packed(bad[:1] if bad != b"\x05" else b"").number()
    with pytest.raises(G.GlassError):
        G.decode_positions(b"\xff\x7f\x01")


def test_inside_an_archive(spark, tmp_path):
    """The index of an archive, read by Spark from where it lies; one that is stored compressed is not."""
    terms, data, positions, values, meta = sample(120)
    raw = writing.database(terms, data, positions, values, meta)
    rows = [("C", "Apple", "Apple", b"<p>a"), ("X", "fulltext/xapian", "", raw)]
    (tmp_path / "a.zim").write_bytes(writing.archive(rows, 0))
    packed = writing.archive([*rows[:1], ("C", "odd", "", raw)], 5)
    (tmp_path / "b.zim").write_bytes(packed)
    a = zim.Archive(str(tmp_path / "a.zim"))
    ((path, at, n),) = a.index_ranges("fulltext")
    assert open(path, "rb").read()[at : at + n] == raw and a.index_ranges("title") is None
    assert zim.Archive(str(tmp_path / "b.zim")).index_ranges("fulltext") is None
    spark.dataSource.register(G.GlassSource)
    read = spark.read.format("glass").option("path", str(tmp_path / "a.zim")).option("index", "fulltext")
    got = read.option("table", "postings").load().groupBy("term").count().collect()
    assert {bytes(r["term"]): r["count"] for r in got} == {t: len(p) for t, p in terms.items()}
    assert read.option("table", "documents").load().count() == len(data)
    assert {(bytes(r.term), r.docid): r.positions for r in read.option("table", "positions").load().collect()} == positions
    with pytest.raises(Exception, match="uncompressed"):
        spark.read.format("glass").option("path", str(tmp_path / "b.zim")).option("index", "fulltext").load().collect()


def shuffled(table):
    """A table of an archive's index that is made of documents in any order."""
    pdf = pd.DataFrame({"archive": "en-0", "doc_id": [3, 1, 2], "text": ["pier mole", "mole quay mole", "quay"]})
    return sorted(all_of(G.Database(zim.Archive(registry._make_archive(pdf)).index_ranges("fulltext")), table))


def test_positions_of_documents_in_any_order():
    assert shuffled("positions") == [(b"mole", 1, [1, 3]), (b"mole", 3, [2]), (b"pier", 3, [1]), (b"quay", 1, [2]), (b"quay", 2, [1])]


def test_postings_of_documents_in_any_order():
    assert shuffled("postings") == [(b"mole", 1, 2), (b"mole", 3, 1), (b"pier", 3, 1), (b"quay", 1, 1), (b"quay", 2, 1)]


def test_values_of_documents_in_any_order():
    assert shuffled("values") == [(0, 1, b"mole quay mole"), (0, 2, b"quay"), (0, 3, b"pier mole"), (1, 1, b"3"), (1, 2, b"1"), (1, 3, b"2")]


def test_packed_numbers_at_the_edges_of_their_sizes():
    for n in (0, 1, 0x7F, 0x80, (1 << 14) - 1, 1 << 14, (1 << 21) - 1, 1 << 21):
        raw = G.pack_number(n)
        assert G.Packed(raw).number() == n and len(raw) == max(1, (n.bit_length() + 6) // 7)
    with pytest.raises(ValueError):
        G.pack_number(-1)
