"""Sections, links and context packing over article tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns

HREF = r'<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


def page_title(html):
    """<title>, else the first heading; tags dropped, white space collapsed."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))
    title, head = clean(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), clean(F.regexp_extract(html, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
    return F.when(title != "", title).when(head != "", head)


def page_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, ord, href, label) of every link in document order."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(id_col, F.posexplode(found).alias("ord", "href"))


def first_per_target(links: DataFrame, source: str, target: str, order: str = "ord") -> DataFrame:
    """Links distinct by target, the first wins; numbered in document order."""
    w = Window.partitionBy(source, target).orderBy(order)
    once = links.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(source).orderBy(order)))


def link_targets(links: DataFrame, entries: DataFrame, hops: int = 49) -> DataFrame:
    """links (n, text, ns, path, fragment) of a page with what each leads to: (n, text, ns, path, fragment, exists, title).

    entries: of one archive. A redirect is followed one entry a step, for the few rows of the page only.
    """
    spark = links.sparkSession
    there = entries.select(F.col("ns").alias("t_ns"), F.col("path").alias("t_path"), F.col("title").alias("t_title"), F.col("kind").alias("t_kind"), "idx", "redirect_idx")
    found = [r.asDict() for r in links.join(there, (F.col("ns") == F.col("t_ns")) & (F.col("path") == F.col("t_path")), "left").select("n", "text", "ns", "path", "fragment", "t_title", "t_kind", "redirect_idx").collect()]
    for _ in range(hops):
        open_rows = {r["redirect_idx"] for r in found if r["t_kind"] == "redirect"}
        if not open_rows:
            break
        at = {r.idx: r for r in there.filter(F.col("idx").isin(sorted(open_rows))).collect()}
        for r in found:
            if r["t_kind"] == "redirect":
                e = at.get(r["redirect_idx"])
                r |= {"to": (e.t_ns, e.t_path), "t_title": e.t_title, "t_kind": e.t_kind, "redirect_idx": e.redirect_idx} if e else {"t_kind": None}
    rows = [(r["n"], r["text"], *(r.get("to", (r["ns"], r["path"])) if r["t_kind"] == "item" else (r["ns"], r["path"])), r["fragment"], r["t_kind"] == "item", (r["t_title"] or r.get("to", (None, r["path"]))[1]) if r["t_kind"] == "item" else None) for r in found]
    return spark.createDataFrame(rows, "n int, text string, ns string, path string, fragment string, exists boolean, title string")


def plain_section(markdown: str) -> str:
    """A section's Markdown without marks of headings, emphasis and link targets."""
    import re

    text = re.sub(r"(?m)^#+ ", "", markdown)
    return re.sub(r"\*\*|~~|`", "", re.sub(r"!?\[([^\]]*)\](\([^)]*\))?", r"\1", text))


def section_ends(sections: DataFrame, doc: str, start: str, level: str, end) -> DataFrame:
    """Each section ends where the next of a level no deeper begins, else where the document does."""
    later = F.collect_list(F.struct(F.col(start).alias("s"), F.col(level).alias("l"))).over(Window.partitionBy(doc).orderBy(start).rowsBetween(1, Window.unboundedFollowing))
    nxt = F.array_min(F.transform(F.filter(later, lambda x: x["l"] <= F.col(level)), lambda x: x["s"]))
    return sections.withColumn("end", F.coalesce(nxt, end))


def find_section(sections: DataFrame, doc: str, name: str) -> DataFrame:
    """By number if `name` is one; else the first title that equals, begins with, or contains it, whatever the case."""
    if name.isdigit():
        return sections.filter(F.col("ord") == int(name))
    low, want = F.lower("title"), name.lower()
    match = F.when(low == want, 0).when(low.startswith(want), 1).when(low.contains(want), 2)
    hit = sections.withColumn("m", match).filter("m is not null")
    return hit.groupBy(doc).agg(F.min_by(F.struct("ord", "title"), F.struct("m", "ord")).alias("s")).select(doc, "s.*")


def pack(excerpts: DataFrame, budget: int, max_hits: int, least_tail: int = 200) -> DataFrame:
    """excerpts (query, rank, text): whole excerpts in rank order under the budget, then one trimmed to what is left if that is `least_tail` or more.

    chars: what each takes of the budget. The trimmed one ends at white space, with an ellipsis.
    """
    w = Window.partitionBy("query").orderBy("rank")
    run = excerpts.withColumn("n", F.char_length("text")).withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("k", F.row_number().over(w))
    left = F.lit(budget) - F.col("before")
    whole = F.col("n") <= left
    fits = (F.col("k") <= max_hits) & (whole | (left >= least_tail))
    text = F.when(whole, F.col("text")).otherwise(columns.trim_chars(F.col("text"), left.cast("int")))
    return run.filter(fits).select("query", "rank", text.alias("text"), F.when(whole, F.col("n")).otherwise(left).cast("long").alias("chars"), (~whole).alias("cut"))
