"""The vote of nearest neighbours against a loop over them."""

import zlib

import numpy as np
from quarry.llm import quality_knn as Q


def brute(model: Q.Model, row: np.ndarray) -> float:
    if not row.any() or not len(model.labels):
        return model.prior
    v = model._weighted(row[None]).astype(float)[0] @ model.axes
    v = v / np.sqrt((v * v).sum())
    near = sorted(((-round(float(v @ x), 9), k) for k, x in enumerate(model.vectors)))[: Q.NEIGHBOURS]
    w = [max(0.0, -s) ** Q.SHARPNESS for s, _ in near]
    return sum(a * model.labels[k] for a, (_, k) in zip(w, near, strict=True)) / sum(w)


def texts():
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), r.integers(1, 8)))
    out = []
    for k in range(300):
        line = " ".join(word() for _ in range(r.integers(1, 60)))
        out.append((line.upper() + " $$$ " * 5 if k % 3 == 0 else line.capitalize() + ".", int(k % 3 > 0)))
    return out + out[:60]  # copies: many neighbours are equally near


def test_votes():
    rows = texts()
    x = np.stack([Q.features(t) for t, _ in rows])
    model = Q.Model(x[:200], np.array([y for _, y in rows[:200]], float))
    assert np.allclose(model.score(x), [brute(model, row) for row in x], atol=1e-9)
    assert np.array_equal(model.score(x), np.concatenate([model.score(row[None]) for row in x]))


def test_ties_go_to_the_smaller_id(monkeypatch):
    monkeypatch.setattr(Q, "NEIGHBOURS", 2)
    x = np.stack([Q.features("same words here")] * 5 + [Q.features("OTHER!")])
    assert Q.Model(x, np.array([1, 0, 0, 0, 0, 0.0])).score(x[:1])[0] == 0.5


def test_words_count():
    """Texts of one form are told apart by their words."""
    good, bad = ["river stone morning quiet", "stone quiet river light"], ["casino bonus jackpot winner", "winner jackpot casino spins"]
    pairs = [(f"{a} {b}", y) for y, own in ((1, good), (0, bad)) for a in own for b in own] * 12
    x = np.stack([Q.features(t) for t, _ in pairs])
    model = Q.Model(x, np.array([y for _, y in pairs], float))
    got = model.score(np.stack([Q.features("morning river quiet light"), Q.features("spins casino bonus winner")]))
    assert got[0] > 0.8 and got[1] < 0.2


def test_rows(spark):
    rows = [(i, t) for i, (t, _) in enumerate(texts())] + [(7, "another text of the same id"), (None, "no id"), (900, None), (901, " \n"), (902, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    got = Q.score(docs, labels).collect()
    learned = {}
    for i, t in sorted(rows, key=str):
        if i is not None and i < 300 and zlib.crc32(str(i).encode()) % 5 and not (i == 7 and t.startswith("another")):
            learned[i] = t
    sevens = Q.fit(docs, labels)
    model = Q.Model(np.stack([Q.features(learned[i]) for i in sorted(learned)]), np.array([0.0 if i == 5 else float(i % 3 > 0) for i in sorted(learned)]))
    assert len(got) == len(rows) and len(sevens.labels) == len(learned)
    if zlib.crc32(b"7") % 5 == 0:  # held out, so it does not matter which of its texts would have been learned
        want = sorted((str(i), round(brute(model, Q.features(t)), 6)) for i, t in rows)
        assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want
    kept = Q.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
