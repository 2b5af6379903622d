import random
import re

import numpy as np
import pytest

from quarry.llm import near_dedup as N
from quarry.llm.components import components

low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, n, percent=80):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    comp = {}
    for i, (d, _) in enumerate(rows):
        comp.setdefault(top(i), []).append(d)
    return sorted((d, len(sets[i]), min(comp[top(i)]), d == min(comp[top(i)])) for i, (d, _) in enumerate(rows))


def corpus(seed, families=12, copies=14, hot=150):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghijklmnop") + str(r.randint(0, 400))
    texts = []
    passage = [word() for _ in range(50)]
    for f in range(families):
        base = [word() for _ in range(r.choice([1, 2, 5, 12, 60, 200]))]
        for _ in range(r.randint(1, copies) if f else hot):
            t = list(base)
            for _ in range(r.randint(0, max(0, len(t) // 40))):
                t[r.randrange(len(t))] = word()
            texts.append(" ".join(t))
    texts += [" ".join([*passage, *(word() for _ in range(r.randint(20, 90)))]) for _ in range(60)]
    texts += ["", " \n", None, "A B", "a\tb", "a b c", "é", "É"] + [texts[0]] * 20 + [texts[1].upper()]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted(map(tuple, N.near_duplicates(df, 4).collect()))
    assert got == brute(rows, 4)


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "A b c d e"), (8, None), (None, "x"), (4, "other words"), (1, "long " * 60_000)], "doc_id long, text string")
    got = sorted(map(tuple, N.near_duplicates(df, 5).collect()), key=str)
    assert got == sorted([(None, 1, 4, False), (4, 1, 4, True), (4, 1, 4, True), (4, 1, 4, True), (9, 1, 4, False), (8, 0, 8, True), (None, 1, None, True), (1, 1, 1, True)], key=str)
    assert N.near_duplicates(df.limit(0)).collect() == []


def test_estimates():
    r = np.random.default_rng(5)
    for n in (100, 1000, 9000):
        for j in (0.3, 0.8, 0.95):
            u = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            k = int(n * j)
            a, b = np.sort(u[: k + (n - k) // 2]), np.sort(np.concatenate([u[:k], u[k + (n - k) // 2 :]]))
            e = N.estimate(N.sketch(a)[None], N.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
            assert abs(e - j) < 0.17, (n, j, e)


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(r.randint(100, 160), r.randint(100, 160)) for _ in range(40)] + [(300, x) for x in range(301, 340)]
    up = {}
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: top(x) for a, b in edges for x in (a, b) if any(p != q for p, q in edges if x in (p, q))}


def test_open_links_deal_both_sides(spark, monkeypatch):
    """Documents of one template that stay in components of their own, and a few pairs of near copies among them."""
    r = np.random.default_rng(9)
    draw = lambda n: r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    template, sets = draw(60), {}
    for i in range(240):
        sets[i] = np.unique(np.concatenate([template, draw(40)]))
        if i % 4 == 3:
            sets[i] = np.unique(np.concatenate([sets[i - 1][:-9], draw(9)]))
    rows = spark.createDataFrame([(1, i, i) for i in sets], "key long, node long, comp long")
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, items binary")
    want = {(i, j) for j in sets for i in range(j) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    seen, wrap = [], type(rows.groupBy("key")).applyInPandas

    def watched(self, run, schema):
        if schema == "a long, b long":
            seen.append(max(x["count"] for x in self.count().collect()))
        return wrap(self, run, schema)

    monkeypatch.setattr(type(rows.groupBy("key")), "applyInPandas", watched)
    assert {tuple(x) for x in N._open_links(rows, table, 80, 20).collect()} == want and len(want) >= 50
    assert max(seen) <= 90, seen


def test_keep(spark):
    a, b, c = "a b c d e f", "B c d e f g h", "one two three four five six"
    rows = [(None, a, 1), (4, a, 2), (None, b, 3), (5, a.upper(), 4), (5, c, 5), (6, None, 6), (7, " ", 7), (7, " ", 7), (8, c, 8), (9, c + " seven", 9), (9, c + " seven", 9), (None, "z", 10), (None, "z", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root long")
    got = N.keep(df)
    assert got.columns == df.columns and sorted(r.root for r in got.collect()) == [2, 3, 5, 6, 7, 7, 9, 10]
    assert N.keep(df.limit(0)).collect() == []
