import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b\n\n c", "it's we'll I'M", "ééé ñandú ß 漢字かな 한국어 🙂🙂", "<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|>", "<|endof", "aaaaaaaaaaaaaaaaaaaaa", "ababababab", "\x00\x1c\x1d\x85\xa0  a　b", "1234567890 12.5e10", "á ́", "\t\t\tx\r\n\r\ny", "word" * 3000, "-" * 5000, "퟿�\U0010ffff"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def test_same_as_library(library):
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("abcdeéßñ '’ \n\t12,.!🙂á\x1f​") for _ in range(r.randint(0, 80))) for _ in range(600)]
    own = bpe.ByteBPE(PATH)
    for t, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, repr(t)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_one_very_long_word(library):
    """Texts without white space are one word each, of letters that merge little and of letters that merge much."""
    r = random.Random(8)
    for t in ("".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(60_000)), "the" * 30_000):
        ids = next(bpe.ByteBPE(PATH).encode_batch([t])).tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids and bpe.ByteBPE(PATH).decode(ids) == t


def test_small_memory_gives_the_same():
    a, b = bpe.ByteBPE(PATH), bpe.ByteBPE(PATH, limit=3)
    for x, y in zip(a.encode_batch(ODD), b.encode_batch(ODD), strict=True):
        assert x.tolist() == y.tolist()


def test_rows(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, "n"), (3, ODD[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_digests(df, PATH).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(df.limit(0), PATH).count() == 0
    back = bpe.decode_column(bpe.encode_column(df, PATH), PATH).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
