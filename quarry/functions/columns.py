"""Column expressions of the archive domain; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Simplified tokens: runs of letters, marks, digits and underscores of the lower-cased text.
TOKEN = r"[\p{L}\p{M}\p{N}_]+"
K1, K3, B, MIN_NORM = 1.0, 1.0, 0.5, 0.5
SUGGEST_K1, SUGGEST_B = 0.001, 1.0


def simple_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def term_weight(n: Column, tf: Column, wqf: Column = None, k1: float = K1) -> Column:
    """BM25 weight of a query term: the idf is floored before the logarithm, so it is never negative."""
    wqf = F.lit(1.0) if wqf is None else wqf.cast("double")
    x = (n - tf + F.lit(0.5)) / (tf + F.lit(0.5))
    x = F.when(x < 2, x * 0.5 + 1).otherwise(x)
    return F.log(x) * ((K3 + 1) * wqf / (K3 + wqf)) * (k1 + 1)


def doc_part(weight: Column, wdf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """A term's share of a document's score."""
    norm = F.greatest(length / average, F.lit(MIN_NORM))
    return weight * wdf / (k1 * (norm * b + (1 - b)) + wdf)


def display_title(title: Column, path: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", path).otherwise(title)


def user_path(ns: Column, path: Column, new_scheme: Column) -> Column:
    return F.when(new_scheme, path).otherwise(F.concat(ns, F.lit("/"), path))


def full_path(ns: Column, path: Column) -> Column:
    return F.concat(ns, F.lit("/"), path)


def uri(archive: Column, path: Column) -> Column:
    return F.concat(F.lit("zim://"), archive, F.lit("/"), path)


def sanitise_name(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"[\s/\\:#?]", "_")


def split_long_path(path: Column) -> Column:
    """struct(ns, path) of `C/foo/bar` or `/C/foo/bar`; nulls where it is no long path."""
    pattern = r"^/?([^/])/(.*)$"
    ok = path.rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(path, pattern, 1)).alias("ns"), F.when(ok, F.regexp_extract(path, pattern, 2)).alias("path"))


def kind_or_mime(kind: Column, mime: Column) -> Column:
    """What an entry is shown as: its type, or the kind of an entry without content; a type outside the archive's list is unknown."""
    return F.when(kind == "item", F.coalesce(mime, F.lit("unknown"))).otherwise(kind)


def agent_path(path: Column) -> Column:
    """The path that a caller means: without `zim://archive/`, fragment and leading slashes."""
    bare = F.regexp_replace(path, "^zim://[^/]*/", "")
    return F.regexp_replace(F.split_part(bare, F.lit("#"), F.lit(1)), "^/+", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def char_window(text: Column, offset: int, length: int) -> Column:
    """struct(content, total, next_offset) of a window of code points; next_offset is null at the end."""
    total = F.char_length(text)
    return F.struct(F.substring(text, offset + 1, length).alias("content"), total.alias("total"), F.when(total > offset + length, F.lit(offset + length)).alias("next_offset"))


def trim_chars(text: Column, n: int | Column) -> Column:
    """The first n characters up to the last white space, with an ellipsis, where the text is longer."""
    n = F.lit(n) if isinstance(n, int) else n
    cut = F.regexp_replace(F.substring(text, F.lit(1), n), r"\s+\S*\z", "")
    return F.when(F.char_length(text) <= n, text).otherwise(F.concat(cut, F.lit("…")))


def parse_tags(tags: Column) -> Column:
    """Tags `a;_k:v` as array<struct<key, value>>; plain tags have a null value."""
    parts = F.filter(F.transform(F.split(tags, ";"), lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(parts, lambda t: F.struct(F.regexp_extract(t, "^_?([^:]*)", 1).alias("key"), F.when(t.contains(":"), F.regexp_extract(t, "^[^:]*:(.*)$", 1)).alias("value")))


def parse_counter(counter: Column) -> Column:
    """`mime=n;...` as array<struct<mime, n>>. Parameters of a MIME type may hold `=`, so the last one counts."""
    parts = F.filter(F.split(counter, r";(?=[^;=]*/)"), lambda p: p.rlike(r"=\d+$"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(.*)=(\d+)$", 1).alias("mime"), F.regexp_extract(p, r"^(.*)=(\d+)$", 2).cast("long").alias("n")))


def illustration(key: Column) -> Column:
    pattern = r"^Illustration_(\d+)x(\d+)@(\d+)$"
    return F.struct(*(F.when(key.rlike(pattern), F.regexp_extract(key, pattern, k)).cast("int").alias(n) for k, n in ((1, "width"), (2, "height"), (3, "scale"))))


def human_size(size: Column) -> Column:
    unit = F.when(size < 1 << 10, F.concat(size.cast("string"), F.lit(" B")))
    for power, name in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        unit = unit.when(size < 1 << 10 * (power + 1), F.concat(F.format_string("%.1f", F.bround(size / float(1 << 10 * power), 1)), F.lit(f" {name}")))
    return unit.otherwise(F.concat(F.format_string("%.1f", F.bround(size / float(1 << 40), 1)), F.lit(" TiB")))


def matches_filter(term: str, *columns: Column) -> Column:
    """Case-insensitive substring over any of the columns; arrays match by any element."""
    needle = term.lower()
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return out


def glob_regex(pattern: str) -> str:
    """A case-insensitive regular expression of a glob with * and ?."""
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def priority(name: Column, rules: list[tuple[str, float]]) -> Column:
    """The weight of the first matching glob, else 1."""
    if not rules:
        return F.lit(1.0)
    out = None
    for pattern, weight in rules:
        hit = name.rlike(glob_regex(pattern))
        out = F.when(hit, F.lit(float(weight))) if out is None else out.when(hit, F.lit(float(weight)))
    return out.otherwise(F.lit(1.0))


def rrf(rank: Column, weight: Column, boost: Column = None, k: int = 60) -> Column:
    """Reciprocal-rank share of a 0-based rank; weights that are no positive number count as 1."""
    w = F.when(weight.isNull() | F.isnan(weight) | (weight <= 0) | (weight == float("inf")), F.lit(1.0)).otherwise(weight)
    out = w / (F.lit(float(k)) + rank + 1)
    return out if boost is None else out + boost * w / F.lit(float(k + 1))


def title_boost(title: Column, query: Column) -> Column:
    """1 for the same normalised title, 0.5 if the title has all query terms, else 0."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    q, t = F.array_distinct(simple_terms(query)), simple_terms(title)
    return F.when(norm(title) == norm(query), 1.0).when((F.size(q) > 0) & (F.size(F.array_except(q, t)) == 0), 0.5).otherwise(0.0)


def contains_phrase(terms: Column, phrase: list[str]) -> Column:
    """Whether the array has the phrase as neighbours in order. Terms hold no blanks, so one joined string is searched: each text is cut once."""
    if not phrase:
        return F.lit(True)
    return F.coalesce(F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" ")).contains(f" {' '.join(phrase)} "), F.lit(False))


def normalise_href(href: Column) -> Column:
    """kind of a link target: external, anchor or internal."""
    return F.when(href.rlike(r"^(?i)([a-z][a-z0-9+.-]*:|//)"), "external").when(href.startswith("#"), "anchor").otherwise("internal")
