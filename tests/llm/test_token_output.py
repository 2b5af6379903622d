import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import token_output as T

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "The CAFÉ café  x y z", "it's <|startoftext|>now<|endoftext|>", "\x1c\x1da\x85b", "ΣΑΣ İstanbul ǅ", "x" * 4000, "a b\x0bc\x0cd\r\ne", "漢字 🙂 1234", " ́a", "가각ᆨ"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3000), max_size=1500))
def test_elias_fano(gaps):
    ends = np.cumsum(np.array(gaps, np.int64))
    e = T.EliasFano.frombytes(T.EliasFano.encode(ends).tobytes())
    assert list(e) == ends.tolist()
    for i, j in ((0, len(ends)), (1, len(ends)), (len(ends) // 3, len(ends) // 2), (700, 701)):
        if j <= len(ends):
            assert e.selects(i, j).tolist() == ends[i:j].tolist()
    for i in range(0, len(ends), 37):
        assert e.select(i) == ends[i]
    with pytest.raises(IndexError):
        e.select(len(ends))


def test_space_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(1).integers(0, 900, 100_000))
    assert len(T.EliasFano.encode(ends).tobytes()) < 100_000 * 11.5 / 8


def test_word_encoder_same_as_library():
    tok = Tokenizer.from_file(PATH)
    for limit in (3, 10_000):
        enc = T.WordEncoder(PATH, np.uint16, limit)
        for t, data in zip(ODD, enc.encode(ODD), strict=True):
            assert np.frombuffer(data, np.uint16).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark, tmp_path):
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 50, t, 1) for i, t in enumerate(ODD)] + [(None, None, 2), (7, "again", 3), (7, "again", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    _, entries = T.write_tokens(df, PATH, f"file://{tmp_path}/t", 3)
    got = [tuple(r) for r in T.read_tokens(spark, entries).orderBy("start").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for doc_id, start, n, crc, ids in got:
        texts = [t or "" for i, t, _ in rows if i == doc_id]
        assert start == at and n == len(ids)
        assert ids in [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += n
    reader = T.ShardReader(entries[0]["path"])
    assert all(reader.document(k).tolist() == ids.tolist() for k, (_, _, ids) in enumerate(reader.scan(5)))
    assert T.token_digests(spark, entries).count() == len(rows)


def test_shard_of_any_ids(tmp_path):
    w = T.ShardWriter(f"file://{tmp_path}", "s", 2)
    ids = [None, None, -(1 << 63), -5, -5, 0, 3, (1 << 63) - 1]
    for k, i in enumerate(ids):
        w.add(i, b"ab" * (k % 3))
    assert w.close() == (8, 7)
    r = T.ShardReader(f"file://{tmp_path}/s")
    assert [x[0] for x in r.scan(2)] == ids == [r.doc_id(i) for i in range(8)]
    assert [(x[1], len(x[2])) for x in r.scan(2)] == [(0, 0), (0, 1), (1, 2), (3, 0), (3, 1), (4, 2), (6, 0), (6, 1)]


def test_shards_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "SHARD_BYTES", 100)
    _, entries = T.write_tokens(spark.createDataFrame([(i, "a b c d e") for i in range(200)], "doc_id long, text string"), PATH, f"file://{tmp_path}/t")
    assert len(entries) == 18 and sum(e["n_docs"] for e in entries) == 200


def test_empty_table(spark, tmp_path):
    _, entries = T.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, f"file://{tmp_path}/t")
    assert entries == []
    assert T.token_digests(spark, entries).collect() == []
