import hashlib
import random

import numpy as np
import pytest

from quarry.llm import suffix_dedup as S


def brute(rows):
    least = {}
    top = lambda i: 1 << 62 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, 1 << 63), top(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < top(i):
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgé ") for _ in range(n))
    passages = [text(n) for n in (49, 50, 51, 70, 140, 300)] + ["ab" * 60, "-" * 120]
    rows = []
    for i in range(90):
        t = "".join(r.choice([text(r.randint(0, 80)), r.choice(passages), r.choice(passages)[r.randint(0, 30) :]]) for _ in range(r.randint(0, 6)))
        rows.append((i * 5 % 90, t))
    hot = text(700)
    rows += [(200 + k, hot[: 700 - k % 7]) for k in range(40)] + [(None, hot), (None, hot), (7, hot), (7, hot), (300, None), (301, ""), (302, "x" * 20_000), (1, "x" * 49)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3_000, 4 << 20])
def test_same_as_brute_force(spark, block):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")
        got = S.dedup_spans(df, block, 5_000, with_text=True).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    assert S.dedup_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_grams_and_minimum():
    r = np.random.default_rng(1)
    x = r.integers(0, 3, 400).astype(np.uint8)
    for k in (1, 2, 3, 24, 31):
        h = S.byte_grams(x, k)
        assert len(h) == 400 - k + 1
        of = {}
        for i, v in enumerate(h.tolist()):
            assert of.setdefault(x[i : i + k].tobytes(), v) == v
        assert len(set(of.values())) == len(of)
        assert S.sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(400 - k + 1)]


@pytest.mark.parametrize("block", [6_000, 4 << 20])
def test_hot_anchor_is_split(spark, monkeypatch, block):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    line, kept = text(26), {}
    rows = [(i, text(60) + line + text(60)) for i in range(300)]
    rows += [(1000 + i, "z" * i + rows[i][1][3:]) for i in range(0, 300, 5)] + [(None, rows[8][1])]
    write = S.common.materialise
    monkeypatch.setattr(S.common, "materialise", lambda df, name, *a: kept.setdefault(name, write(df, name, *a)))
    monkeypatch.setattr(S.common, "release", lambda *tables: None)
    shard = 8_000
    got = S.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), block, shard).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    size = {}
    for x in kept["segments"].collect():
        size[x.shard] = size.get(x.shard, 0) + len(S._unpack(x.data))
    assert max(size.values()) < 2 * shard, sorted(size.values())[-3:]
