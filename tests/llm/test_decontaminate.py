import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import decontaminate as C

low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items):
    out = []
    windows = {}
    for item, t in items:
        w = C.WORD.findall(low(t))
        for k in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    for i, t in docs:
        w = C.WORD.findall(low(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    text = lambda n, v: " ".join(r.choice("abcdefghij"[:v]) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 3, 12, 13, 14, 30]), 10)) for k in range(12)] + [(90, None), (91, "... !"), (3, "A a-A"), (None, "é-É b")]
    items += items[:3]
    docs = [(k, text(r.randint(0, 60), r.choice([2, 10])) + " " + (r.choice(items)[1] or "") + ". " + text(5, 10)) for k in range(60)]
    return docs + [(None, None), (7, ""), (7, items[0][1]), (8, text(30_000, 10))], items


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_winnowing_covers_every_window(xs):
    h = np.array(xs, np.uint64)
    at, _ = C.winnow(h)
    for s in range(len(h) - C.WINDOW + 1):
        assert any(s <= p <= s + C.WINDOW - C.K for p in at)


def test_rows(spark):
    for seed in range(3):
        docs, items = case(seed)
        d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
        b = spark.createDataFrame(items, "item_id long, text string")
        want = brute(docs, items)
        assert sorted(map(tuple, C.judge(d, b).collect()), key=str) == want
        assert sorted(map(tuple, C.judge(d, b, max_windows=20).collect()), key=str) == want
        if not seed:
            assert C.judge(d.limit(0), b).collect() == C.judge(d.limit(0), b, max_windows=0).collect() == []
            assert {r.n_hit for r in C.judge(d, b.limit(0)).collect()} == {0}


@pytest.mark.parametrize("most", [C.MAX_WINDOWS, 20])
def test_clean(spark, most):
    """Whatever the path, rows go by their own text: ids may be null or repeat, and extra columns may have any name."""
    passage = " ".join(f"p{k}" for k in range(20))
    long, fine = "x y z " * 400 + passage, "nothing of that kind"
    rows = [(None, long, 1), (None, fine, 2), (7, passage[3:], 3), (7, fine, 4), (8, fine, 5), (9, None, 6), (10, "", 7), (11, "short one", 8), (12, "a short one " + "b " * 90, 9), (8, fine, 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, row long")
    b = spark.createDataFrame([(1, passage), (2, "short one"), (None, "u " * 30), (4, "v " * 40)], "item_id long, text string")
    got = C.clean(d, b, max_windows=most)
    assert got.columns == d.columns and sorted(r.row for r in got.collect()) == [2, 4, 5, 5, 6, 7, 9]
    assert C.clean(d.limit(0), b, max_windows=most).collect() == []
    assert C.clean(d, b.limit(0), max_windows=most).count() == len(rows)


def test_items_of_any_id_type(spark):
    d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    b = spark.createDataFrame([("k-2", "two"), ("k-10", "three")], "item_id string, text string")
    sha = hashlib.sha256(b"k-10,k-2").hexdigest()
    for most in (C.MAX_WINDOWS, 0):
        assert [(r.n_hit, r.items_sha256) for r in C.judge(d, b, max_windows=most).collect()] == [(2, sha)]
