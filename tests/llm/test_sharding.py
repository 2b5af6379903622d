import random
import zlib
from itertools import accumulate

from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sharding as S


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=9), st.integers(1, 5))
def test_minimax_is_least(sizes, shards):
    from itertools import combinations

    best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for k in range(shards) for c in combinations(range(1, len(sizes)), k))
    capacity, cuts = S.minimax(sizes, shards)
    assert capacity == best and len(cuts) < shards
    ends = [0, *accumulate(sizes)]
    assert all(ends[b] - ends[a] <= capacity for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True))


def test_rows(spark):
    r = random.Random(4)
    rows = [(i, "hot text " * 40 if i % 3 == 0 else f"t{r.randint(0, 300)}" * r.randint(1, 30)) for i in range(2000)]
    rows += [(None, None), (1, ""), (5, "é" * 50_000), (5, "é" * 50_000)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, shard int")
    got = S.assign(df).collect()
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((g.doc_id, g.size, g.text_crc32) for g in got), key=str) == sorted(((i, size(t), crc(t)) for i, t in rows), key=str)
    shards, of = {}, {}
    for g in got:
        shards.setdefault(g.shard, []).append(g)
        of.setdefault((g.size, g.text_crc32), set()).add(g.shard)
        assert g.law == "bytes" and g.grown_shard is None and 0 <= g.shard < 24
    assert all(len(v) == 1 for v in of.values())
    for v in shards.values():
        assert sorted(g.slot for g in v) == list(range(len(v)))
    total = {k: sum(g.size for g in v) for k, v in shards.items()}
    hot = max(total.values())
    rest = sorted(v for v in total.values() if v != hot)
    assert len(total) == 24 and S.assign(df.limit(0)).collect() == []
    assert hot == sum(size(t) for _, t in rows if (t or "").startswith("hot"))
    assert rest[-1] == 200_016 and rest[1] > 0.9 * rest[-2]
