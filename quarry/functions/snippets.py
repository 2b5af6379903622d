"""The part of a text that shows a query best: most different terms, then most matches, within a number of characters."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from quarry.functions import analyze

_WORD = re.compile(r"[\w']+")
_GAP = re.compile(r"\s")


class _Words:
    """The words of a text with their query terms; a window is a range of words."""

    def __init__(self, text: str, term_of, mark_cost: int):
        found = list(_WORD.finditer(text))
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.terms = [term_of(m.group()) for m in found]
        self.hits = [0, *accumulate(t is not None for t in self.terms)]
        self.mark_cost = mark_cost

    def size(self, lo: int, hi: int) -> int:
        return self.ends[hi] - self.starts[lo] + self.mark_cost * (self.hits[hi + 1] - self.hits[lo])

    def best(self, budget: int) -> tuple[int, int, int]:
        """First word, last word and different terms of the best window; the earliest of equals."""
        top, where, lo, held = (0, 0), None, 0, Counter()
        for hi, term in enumerate(self.terms):
            if term is not None:
                held[term] += 1
            while lo < hi and self.size(lo, hi) > budget:
                gone = self.terms[lo]
                lo += 1
                if gone is not None:
                    held[gone] -= 1
                    held += Counter()  # drops what fell to 0
            score = (len(held), self.hits[hi + 1] - self.hits[lo])
            if score > top:
                top, where = score, (lo, hi)
        if where is None:
            last = max(1, bisect_left(range(len(self.starts)), True, key=lambda k: self.size(0, k) > budget))
            return 0, last - 1, 0
        return *self._grown(*where, budget), top[0]

    def _grown(self, lo: int, hi: int, budget: int) -> tuple[int, int]:
        """The window with a word more at the right and the left in turn, as long as one of them fits."""
        while True:
            before = lo, hi
            if hi + 1 < len(self.starts) and self.size(lo, hi + 1) <= budget:
                hi += 1
            if lo and self.size(lo - 1, hi) <= budget:
                lo -= 1
            if before == (lo, hi):
                return before


def snippet(text: str, term_of, max_chars: int, marks: tuple[str, str] | None = None, one_line: bool = True) -> tuple[str, int]:
    """The best excerpt of at most max_chars and how many different terms it has. term_of(word) names a word's query term or None."""
    w = _Words(text, term_of, sum(map(len, marks)) if marks else 0)
    if not w.starts:
        return text[:max_chars].strip(), 0
    lo, hi, n = w.best(max(1, max_chars - 2))  # two characters are kept for the dots
    start = max((m.end() for m in _GAP.finditer(text, 0, w.starts[lo])), default=0)
    gap = _GAP.search(text, w.ends[hi])
    end = gap.start() if gap else len(text)
    body, at = [], start
    for k in range(lo, hi + 1):
        if marks and w.terms[k] is not None:
            body += [text[at : w.starts[k]], marks[0], text[w.starts[k] : w.ends[k]], marks[1]]
            at = w.ends[k]
    out = ("…" if text[:start].strip() else "") + "".join(body) + text[at:end] + ("…" if text[end:].strip() else "")
    out = " ".join(out.split()) if one_line else re.sub(r"\n{3,}", "\n\n", out.strip())
    return (out if len(out) <= max_chars else out[: max(0, max_chars - 1)] + "…"), n


def term_finder(query: list[str], language: str | None):
    """Names the query term that a word's first index term is, if any."""
    at = {t: k for k, t in enumerate(dict.fromkeys(query))}

    def find(word: str) -> int | None:
        found = analyze.terms(word, language)
        return at.get(found[0]) if found else None

    return find


def snippets(text: Column, query: str, language: Column, max_chars: int = 300, marks: tuple[str, str] | None = ("**", "**")) -> Column:
    """The best excerpt of each row. Put it after limits: it reads every text it sees."""

    @arrow_udf(StringType())
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        finders: dict = {}
        out = []
        for t, lang in zip(texts.to_pylist(), languages.to_pylist(), strict=True):
            if lang not in finders:
                finders[lang] = term_finder(analyze.terms(query, lang), lang)
            out.append(None if t is None else snippet(t, finders[lang], max_chars, marks)[0])
        return pa.array(out, pa.string())

    return run(text, F.coalesce(language, F.lit("")))
