"""The full text analysis: accents, word rules, unbroken scripts, stems. Kernels first, their Arrow functions below.

A text is cut by one regular expression, so each rule is one alternative of it. No rule looks over white space, so the terms of what
stands between it are remembered, and stems by word.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.stemmers import stemmer_for

MAX_BYTES = 64
# Word characters, scripts without word separators, and the characters that join words or numbers.
WORD = r"\p{L}\p{M}\p{N}\p{Pc}"
UNBROKEN = r"\u2E80-\u2EFF\u3000-\u9FFF\uA700-\uA71F\uAC00-\uD7AF\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFFEF\U00020000-\U0002A6DF\U0002F800-\U0002FA1F"
ZERO_WIDTH = r"\u200B-\u200D\u2060\uFEFF"
JOIN = r"'&\u00B7\u05F4\u2027\u2019\u201B" + ZERO_WIDTH
JOIN_DIGITS = r",.;\u037E\u0589\u060D\u07F8\u2044\uFE10\uFE13\uFE14" + ZERO_WIDTH

_INFIX = rf"(?:(?<=\p{{Nd}})[{JOIN_DIGITS}](?=\p{{Nd}})|(?!(?<=\p{{Nd}}).\p{{Nd}})[{JOIN}](?=[{WORD}]))"
_PLAIN = rf"[[{WORD}]--[{UNBROKEN}]]"


@lru_cache(2)
def _cutter(ngrams: bool):
    plain = _PLAIN if ngrams else f"[{WORD}]"
    run = rf"(?P<run>[[{WORD}]&&[{UNBROKEN}]]+)|" if ngrams else ""
    initials = rf"(?P<initials>[A-Z](?:\.[A-Z])++\.?+(?![{WORD}]))|"
    # A word before a joiner and an unbroken script is lost.
    word = rf"(?P<word>{plain}+(?:{_INFIX}{plain}+)*+)(?P<lost>{_INFIX})?(?P<suffix>[+#]{{1,3}}+(?![+#{WORD}]))?"
    return regex.compile(initials + run + word, regex.V1 | regex.DOTALL)


_FOLD = {0x2019: "'", 0x201B: "'"} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


class _Marks(dict):
    """character -> null where it is a mark, else itself: a table for str.translate()."""

    def __missing__(self, c: int) -> int | None:
        self[c] = kept = None if unicodedata.category(chr(c))[0] == "M" else c
        return kept


_MARKS = _Marks()


def remove_accents(text: str) -> str:
    """Lower case without marks, composed again."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text.lower()).translate(_MARKS))


def _lower(word: str) -> str:
    return word.lower() if word.isascii() else "".join(c.lower()[0] for c in word).translate(_FOLD)


def tokenize(text: str, ngrams: bool = True) -> list[str]:
    """Lower-cased words: initials as one, joined words, numbers with marks, up to three + or # after a word, and the one- and two-grams of unbroken scripts."""
    out = []
    for m in _cutter(ngrams).finditer(text):
        if m["initials"]:
            out.append(m["initials"].replace(".", "").lower())
        elif ngrams and m["run"]:
            run = m["run"]
            for k, c in enumerate(run):
                out.append(c)
                if k + 1 < len(run):
                    out.append(run[k : k + 2])
        elif m["lost"] is None:
            out.append(_lower(m["word"]) + (m["suffix"] or ""))
    return out


@lru_cache(64)
class _Stems(dict):
    """word -> stem in one language, emptied at a fixed size."""

    def __init__(self, language: str | None):
        self.stem = stemmer_for(language)

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = s = self.stem(word) if self.stem else word
        return s


def stem(word: str, language: str | None) -> str:
    return _Stems(language)[word]


@lru_cache(64)
class _Chunks(dict):
    """What stands between white space -> its terms in one language; long ones are not kept, and all are let go at a fixed number."""

    def __init__(self, language: str | None):
        self.stems = _Stems(language)

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        stems, bare = self.stems, remove_accents(chunk)
        word = bare.strip(".,;:!?")  # these join at most what is on both sides of them
        if word.isascii() and word.isalnum():  # nearly every one
            s = "" if len(word) > MAX_BYTES else stems[word] if stems.stem else word
            out = (s,) if s else ()
        else:
            found = (stems[w] for w in tokenize(bare) if len(w) <= 16 or len(w.encode()) <= MAX_BYTES)
            out = tuple(s for s in found if s)
        if len(chunk) <= 48:
            if len(self) >= 200_000:
                self.clear()
            self[chunk] = out
        return out


def terms(text: str | None, language: str | None = None) -> list[str]:
    """The index terms of a text: words of at most 64 bytes, stemmed."""
    return list(chain.from_iterable(map(_Chunks(language).__getitem__, (text or "").split())))


def term_counts(text: str | None, language: str | None = None) -> dict[str, int]:
    """How often a text has each of its terms."""
    return Counter(chain.from_iterable(map(_Chunks(language).__getitem__, (text or "").split())))


def partial_stem(word: str, language: str | None = None) -> str:
    """Z and the stem where the word begins with a letter that is no capital, else the word as it is: the rule of title indexes."""
    return "Z" + stem(word, language) if unicodedata.category(word[:1] or " ") in ("Ll", "Lt", "Lm", "Lo") else word


def _over(text: pa.Array, language: pa.Array | None, kernel, kind: pa.DataType) -> pa.Array:
    rows = zip(text.to_pylist(), language.to_pylist(), strict=True) if language is not None else ((t, None) for t in text.to_pylist())
    return pa.array([kernel(t, lang) for t, lang in rows], kind)


@arrow_udf(ArrayType(StringType()))
def _terms(text: pa.Array, language: pa.Array) -> pa.Array:
    return _over(text, language, terms, pa.list_(pa.string()))


@arrow_udf(StringType())
def _bare(text: pa.Array) -> pa.Array:
    return _over(text, None, lambda t, _: None if t is None else remove_accents(t), pa.string())


@arrow_udf(ArrayType(StringType()))
def _tokens(text: pa.Array) -> pa.Array:
    return _over(text, None, lambda t, _: tokenize(remove_accents(t or "")), pa.list_(pa.string()))


def index_terms(text: Column, language: Column) -> Column:
    """terms() of a column; the language may differ by row, as archives do."""
    return _terms(text, language)


def bare_words(text: Column) -> Column:
    """The unstemmed words of a column without accents."""
    return _tokens(text)


def without_accents(text: Column) -> Column:
    return _bare(text)


#: So many different terms are held before they are handed on.
HELD = 200_000


def counted_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, archive, term, n) of docs (doc_id, archive, text, language): the terms of each row, counted where the text is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found, counts = [], [], []
            for k, (text, language) in enumerate(zip(b["text"], b["language"], strict=True)):
                own = term_counts(text.as_py(), language.as_py())
                at += [k] * len(own)
                found += own
                counts += own.values()
                if len(at) > HELD or k + 1 == len(b):
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([b["doc_id"].take(rows), b["archive"].take(rows), pa.array(found, pa.string()), pa.array(counts, pa.int64())], ["doc_id", "archive", "term", "n"])
                    at, found, counts = [], [], []

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.select("doc_id", "archive", "text", "language").mapInArrow(run, f"doc_id {kinds['doc_id']}, archive {kinds['archive']}, term string, n long")


def term_totals(docs: DataFrame) -> DataFrame:
    """(archive, term, term_freq, coll_freq) of docs (archive, text, language), of which each row is a document; in parts that may repeat a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def rows() -> pa.RecordBatch:
            archives, found = zip(*held) if held else ((), ())
            docs_, counts = zip(*held.values()) if held else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(archives, pa.string()), pa.array(found, pa.string()), pa.array(docs_, pa.int64()), pa.array(counts, pa.int64())], ["archive", "term", "term_freq", "coll_freq"])

        for b in batches:
            for archive, text, language in zip(b["archive"], b["text"], b["language"], strict=True):
                name = archive.as_py()
                for t, n in term_counts(text.as_py(), language.as_py()).items():
                    own = held.get((name, t))
                    if own is None:
                        held[name, t] = [1, n]
                    else:
                        own[0] += 1
                        own[1] += n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    return docs.select("archive", "text", "language").mapInArrow(run, "archive string, term string, term_freq long, coll_freq long")
