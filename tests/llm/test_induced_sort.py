import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import induced_sort as I


def check(data: bytes, **kw):
    text = np.frombuffer(data, np.uint8)
    pos, lcp = [], []
    for a, b in I.suffixes_descending(text, **kw):
        pos += a.tolist()
        lcp += b.tolist()
    assert sorted(pos) == list(range(len(data)))
    keys = [data[p : p + I.DEPTH] for p in pos]
    # To DEPTH bytes; a suffix that ends is less than any longer one, and zero bytes at the end count as an end.
    for k in range(1, len(keys)):
        x, y = keys[k - 1], keys[k]
        m = 0
        while m < min(len(x), len(y)) and x[m] == y[m]:
            m += 1
        assert x >= y, (k, x, y)
        assert lcp[k] == m, (k, x, y, lcp[k], m)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from([1, 2, 3, 200, 255]), min_size=1, max_size=300))
def test_small_alphabet(xs):
    check(bytes(xs))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from(["abra", "cad", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "b", "the quick brown fox jumps over the lazy dog and runs away", "\xe9"]), min_size=1, max_size=30))
def test_repeats(xs):
    check("".join(xs).encode())


@pytest.mark.parametrize("step", [3, 1 << 20])
def test_spills(tmp_path, monkeypatch, step):
    monkeypatch.setattr(I, "STEP", step)
    r = np.random.default_rng(1)
    check(bytes(r.integers(97, 100, 700).astype(np.uint8)), spill_folder=f"file://{tmp_path}/s", memory=200)
    assert not any((tmp_path / "s").iterdir())
