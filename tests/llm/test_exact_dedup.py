import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import exact_dedup as D

norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@settings(deadline=None, max_examples=40)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_filter_and_index_like_a_dict(ops):
    index, live = D.CuckooIndex(4), {}
    for add, k in ops:
        d = hashlib.sha256(str(k).encode()).digest()
        if add:
            index.insert(d, k, 1)
            live[d] = live.get(d, 0) + 1
        else:
            assert index.delete(d) == (live.pop(d, None) is not None)
    assert {d: e[2] for d, e in index.content.items()} == live
    assert all(index.get(d) for d in live)
    assert index.filter.size == len(live)


def test_overflow_rebuilds_from_stored_keys():
    index = D.CuckooIndex(4)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    for k, d in enumerate(keys):
        index.insert(d, k, 1)
    assert index.resizes >= 5 and all(index.get(d) == (k, 1, 1) for k, d in enumerate(keys))


def test_rows(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["", None, " ", "a b", "ab", "a\tb\n", "a\xa0b", "é  x", "éx", "🙂 ", "🙂"])) for i in range(300)]
    rows += [(None, "ab  "), (5, "zz"), (5, "zz"), (999, "w" * 100_000), (998, " " + "w" * 100_000)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string")
    assert sorted(map(tuple, D.dedup(df).collect()), key=str) == brute(rows)
    assert D.dedup(df.limit(0)).collect() == []


def test_insert_and_delete(spark):
    make = lambda rows: D.digests(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = make([(1, "x"), (2, "y"), (3, "x ")]), make([(4, "y  "), (5, "z")])
    index = D.insert(D.build_index(a, 3), b, 3)
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    got = {bytes(r.digest): (r.keep_id, r.n_chars, r.group_size) for r in index.collect()}
    assert got == {sha("x"): (3, 2, 2), sha("y"): (4, 3, 2), sha("z"): (5, 1, 1)}
    left = D.delete(index, make([(9, "x"), (9, "none")]), 3)
    assert {bytes(r.digest) for r in left.collect()} == {sha("y"), sha("z")}


def test_keep(spark):
    rows = [(None, "a b", 1), (4, "ab", 2), (4, "a  b", 3), (5, "x", 4), (5, "y", 5), (None, "q", 6), (None, "q", 6), (None, "r", 7), (6, None, 8), (7, " ", 9), (8, "x", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own_sha long")
    got = D.keep(df)
    assert got.columns == df.columns and sorted(r.own_sha for r in got.collect()) == [3, 4, 5, 6, 7, 9]
    assert D.keep(df.limit(0)).collect() == []


def test_hot_keys_are_joined_alike(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"t{i // 2}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (1, 3, 100_000):
        monkeypatch.setattr(D.common, "HOT", hot)
        assert sorted(map(tuple, D.dedup(df).collect()), key=str) == brute(rows)
