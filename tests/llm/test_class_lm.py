import math
import random
import re
from collections import Counter

import numpy as np

from quarry.llm import class_lm as L

low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]


def corpus():
    r = random.Random(11)
    tongues = [[f"{c}{k}" for k in range(60)] for c in "abc"]
    rows = []
    for i in range(400):
        t = r.choice(tongues)
        w = [t[min(59, int(r.expovariate(0.1)))] for _ in range(r.randint(0, 120))]
        rows.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w) + (f" odd{i}" if r.random() < 0.3 else "")))
    return rows + [(None, None), (5, "again a1"), (5, "again a1"), (1000, "a1 " * 30_000), (1001, " \n")]


def test_scores(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    c = Counter(w for i, t in rows if not L.held_out(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, L.held_out(i), len(toks(t)), sum(c[w] > 0 for w in toks(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in rows), key=str)
    for block, bucket in ((2_000_000, 400_000), (300, 10)):
        got = L.score(df, block, bucket).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
        assert all(r.score < 0 for r in got)
    assert L.score(df.limit(0)).collect() == []


def test_no_training_rows(spark):
    ids = [i for i in range(200) if L.held_out(i)][:5]
    got = L.score(spark.createDataFrame([(i, "a b") for i in ids], "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in got) and len(got) == 5


def likelihood(b, of, width):
    m = np.zeros((len(b), width))
    m[np.arange(len(b)), of] = 1
    n = m.T @ b @ m
    return L._f(n).sum() - L._f(n.sum(0)).sum() - L._f(n.sum(1)).sum()


def test_exchange_separates_and_climbs():
    r = np.random.default_rng(3)
    b = np.zeros((32, 32))
    b[:15, :15], b[15:30, 15:30] = r.integers(1, 9, (15, 15)), r.integers(1, 9, (15, 15))
    b[30:, :] = b[:, 30:] = 1
    of = L.exchange(b, 2)
    assert len(set(of[:15])) == 1 and len(set(of[15:])) == 1 and of[0] != of[20]
    start = np.concatenate([np.arange(30) % 2, [2, 3]])
    assert likelihood(b, np.concatenate([of, [2, 3]]), 4) > likelihood(b, start, 4)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(4)
    sizes = r.integers(1, 99, L.WIDTH)
    p = 10 ** L.transition_logs(r.integers(0, 9, (L.WIDTH, L.WIDTH)), sizes, 0.03)
    assert np.allclose(p.sum(1), 1)


def test_score_by_hand(spark):
    """The score of each text from the words' classes alone, by counting."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = L.common.materialise(L._blocks(df, 2_000), "b")
    classes = {}
    answers, before, best = L.clustered(blocks, 3)
    if before is not None and L.likelihood(L._matrix(L._contexts(blocks, answers, 3))) <= best:
        answers = before
    told = {}
    for r in sorted(answers.filter("block is not null").collect(), key=lambda r: r.bucket):
        told.setdefault(r.block, []).append(L._unpack(r.classes, np.uint8))
    for b in blocks.collect():
        classes |= dict(zip(np.frombuffer(b.words, np.uint64).tolist(), np.concatenate(told[b.block]).tolist(), strict=True))
    of = lambda w: classes[int(L.END) if w is None else L.common.word_hashes([w]).tolist()[0]]
    train = [toks(t) for i, t in rows if not L.held_out(i)]
    count = Counter(w for t in train for w in t)
    n, once = sum(count.values()), sum(x == 1 for x in count.values())
    assert set(of(w) for w in count) <= {*range(L.CLASSES), L.END_CLASS} and len(set(of(w) for w in count)) > 4
    size, moves = Counter(), Counter()
    for t in train:
        for a, w in zip([None, *t[:-1]], t, strict=True):
            size[of(w)] += 1
            moves[of(a), of(w)] += 1
    unknown = min(0.5, (once + 1) / (n + 2))

    def score(text):
        total, before = 0.0, L.END_CLASS
        for w in toks(text):
            if w not in count:
                total, before = total + math.log10(unknown), L.UNKNOWN
                continue
            c = of(w)
            seen = sum(x for (a, b), x in moves.items() if a == before)
            p = (1 - unknown) * (moves[before, c] + L.SMOOTH * size[c] / n) / (seen + L.SMOOTH)
            total, before = total + math.log10(p) + math.log10(count[w] / size[c]), c
        return total

    got = L.score(df, 2_000, 20_000).collect()
    want = sorted(((i, len(toks(t)), score(t)) for i, t in rows), key=str)
    for (i, k, x), r in zip(want, sorted(got, key=lambda r: str((r.doc_id, r.n_tokens, r.score))), strict=True):
        assert (i, k) == (r.doc_id, r.n_tokens)
    by = lambda rows: sorted((str(i), k, round(x, 5)) for i, k, x in rows)
    assert by((r.doc_id, r.n_tokens, r.score) for r in got) == by(want)


def test_best_class_is_the_likeliest():
    r = np.random.default_rng(8)
    words, classes = 30, 4
    b = r.integers(0, 5, (words + 2, words + 2)).astype(float)
    of = np.concatenate([r.integers(0, classes, words), [classes, classes + 1]])
    member = lambda of: np.eye(classes + 2)[of]
    grams = lambda of: member(of).T @ b @ member(of)
    own = np.diag(b)[:words]
    free = b - np.diag(np.diag(b))
    got = L.best_classes(grams(of), of[:words], (member(of).T @ free).T[:words], (free @ member(of))[:words], own, classes)
    for w in range(words):
        value = [L.likelihood(grams(np.concatenate([of[:w], [c], of[w + 1 :]]))) for c in range(classes)]
        assert got[w] == int(np.argmax(value)) or abs(value[got[w]] - max(value)) < 1e-6
