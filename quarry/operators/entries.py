"""Lookups, redirects, listings and integrity checks over entry tables.

entries: archive, idx, ns, path, title, kind, mime, cluster, blob, redirect_idx.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import columns as C

MAX_HOPS = 49


def find_path(entries: DataFrame, ns: str, path: str) -> DataFrame:
    return entries.filter((F.col("ns") == ns) & (F.col("path") == path))


def find_paths(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """Batched lookup: keys (archive, ns, path) are joined; the planner broadcasts a small key table by its measured size."""
    return entries.join(keys, ["archive", "ns", "path"])


def insertion_point(entries: DataFrame, ns: str, path: str) -> DataFrame:
    """By archive, how many entries sort before (ns, path)."""
    return entries.groupBy("archive").agg(F.count_if((F.col("ns") < ns) | ((F.col("ns") == ns) & (F.col("path") < path))).alias("position"))


def resolve_compat(entries: DataFrame, keys: DataFrame, new_scheme: bool = True) -> DataFrame:
    """keys (archive, want): the first of the candidate places that exists. New: C/<want>, then <ns>/<path> as written; old: as written, then A, I, J, -."""
    long = C.split_long_path(F.col("want"))
    spaces = ["C"] if new_scheme else ["A", "I", "J", "-"]
    bare = [F.struct(F.lit(k + (0 if new_scheme else 1)).alias("pri"), F.lit(ns).alias("ns"), F.ltrim(F.lit("/"), F.col("want")).alias("path")) for k, ns in enumerate(spaces)]
    written = F.struct(F.lit(9 if new_scheme else 0).alias("pri"), long["ns"].alias("ns"), long["path"].alias("path"))
    wide = keys.select("archive", "want", F.explode(F.array(*bare, written)).alias("c")).select("archive", "want", "c.*")
    found = wide.join(entries, ["archive", "ns", "path"])
    return found.groupBy("archive", "want").agg(F.min_by(F.struct("idx", "ns", "path"), "pri").alias("e")).select("archive", "want", "e.*")


def title_prefix(entries: DataFrame, ns: str, prefix: str) -> DataFrame:
    """Byte-wise, case-sensitive prefix range of titles, in title order."""
    shown = entries.withColumn("shown", C.display_title(F.col("title"), F.col("path")))
    return shown.filter((F.col("ns") == ns) & F.col("shown").startswith(prefix)).orderBy("archive", "shown", "idx")


CONTENT = ["C", "A", "I", "J", "-"]


def by_title(entries: DataFrame, titles: list[str]) -> DataFrame:
    """(archive, shown, idx, ns, path): for each archive and title its first entry in the content namespaces, by namespace, then place."""
    shown = entries.withColumn("shown", C.display_title(F.col("title"), F.col("path"))).filter(F.col("ns").isin(CONTENT) & F.col("shown").isin(titles))
    rank = F.array_position(F.array(*map(F.lit, CONTENT)), F.col("ns"))
    best = F.min_by(F.struct("idx", "ns", "path"), F.struct(rank, "idx"))
    return shown.groupBy("archive", "shown").agg(best.alias("e")).select("archive", "shown", "e.*")


def listing(entries: DataFrame, query: str, depth: int, language_case: bool = True) -> DataFrame:
    """Entries of the content namespaces whose title begins with the query, as typed or with a capital: each target once, best titles first.

    (archive, doc_id, title, percent, strength): every hit counts 100 percent and a quarter of a full-text hit's strength.
    """
    forms = list(dict.fromkeys([query, query[:1].upper() + query[1:]])) if language_case else [query]
    shown = entries.withColumn("shown", C.display_title(F.col("title"), F.col("path"))).filter(F.col("ns").isin(CONTENT))
    k = F.when(F.col("shown").startswith(forms[0]), 0)
    for i, f in enumerate(forms[1:], 1):
        k = k.when(F.col("shown").startswith(f), i)
    rows = shown.withColumn("form", k).filter("form is not null").withColumn("target", F.coalesce("redirect_idx", "idx"))
    order = Window.partitionBy("archive").orderBy("form", "shown", "idx")
    first = rows.groupBy("archive", "target").agg(F.min(F.struct("form", "shown", "idx")).alias("f")).select("archive", "target", "f.*")
    best = first.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= depth)
    return best.select("archive", F.col("target").alias("doc_id"), F.col("shown").alias("title"), (F.col("k") - 1).alias("rank"), F.lit(100).alias("percent"), F.lit(0.25).alias("strength"))


def stored_titles(entries: DataFrame, page: DataFrame) -> DataFrame:
    """page (archive, ns, path, title, ...) with each row's title as the directory stores it: index titles may be lower-cased copies.

    A page is a bounded number of rows, so it is broadcast to the entries.
    """
    own = entries.select(F.col("archive").alias("e_archive"), F.col("ns").alias("e_ns"), F.col("path").alias("e_path"), F.nullif("title", F.lit("")).alias("e_title"))
    same = (F.col("archive") == F.col("e_archive")) & (F.col("ns") == F.col("e_ns")) & (F.col("path") == F.col("e_path"))
    found = own.join(F.broadcast(page.select("archive", "ns", "path")), same).select("e_archive", "e_ns", "e_path", "e_title")
    return page.join(found, same, "left").withColumn("title", F.coalesce("e_title", "title")).drop("e_archive", "e_ns", "e_path", "e_title")


def search_mode(select: str, has_fulltext: Column, has_title: Column, has_listing: Column) -> Column:
    """The mode that serves an archive: what is asked for where the archive can do it, for `auto` the first it can do; null for none."""
    can = {"fulltext": has_fulltext, "title": has_title, "listing": has_listing}
    if select == "auto":
        return F.when(has_fulltext, "fulltext").when(has_title, "title").when(has_listing, "listing")
    return F.when(can[select], select)


def resolve_redirects(nodes: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """nodes (id, target): target null for items. Returns (id, final, hops), final null for loops and chains that are too long.

    Pointer doubling: k joins follow 2 ** k redirects, so six joins do what fifty would. Each step is written before the next names it
    twice; otherwise the plan would double as well.
    """
    now = nodes.select("id", F.coalesce("target", "id").alias("at"), F.when(F.col("target").isNull(), 0).otherwise(1).alias("hops"))
    now, step = storage.materialise(now, "redirects"), 1
    while step <= hops:
        old = now
        nxt = now.select(F.col("id").alias("k"), F.col("at").alias("next"), F.col("hops").alias("more"))
        now = now.join(nxt, F.col("at") == F.col("k"), "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        now = storage.materialise(now, "redirects")
        storage.release(old)
        step *= 2
    ends = nodes.filter("target is null").select(F.col("id").alias("item"))
    out = now.join(ends, F.col("at") == F.col("item"), "left")
    ok = F.col("item").isNotNull() & (F.col("hops") <= hops)
    return out.select("id", F.when(ok, F.col("at")).alias("final"), F.when(ok, F.col("hops")).alias("hops"))


def order_problems(entries: DataFrame, key: list[str], order: str = "idx", strict: bool = True) -> DataFrame:
    """Rows whose key does not follow that of the row before (checks of directory and title order).

    Rows are cut into ranges of (archive, order), which an archive may fill several of: each range compares its own rows, and the
    ranges' edges are compared among themselves, a row or two an archive and range.
    """
    spark, row = entries.sparkSession, F.struct(*key)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = entries.select("archive", order, *[k for k in key if k != order]).repartitionByRange(parts, "archive", order).withColumn("part", F.spark_partition_id())
    dealt = storage.materialise(dealt, "ordered")  # the ranges are drawn from a sample: once, not once for each use
    w = Window.partitionBy("part", "archive").orderBy(order)
    wrong = lambda before, own: (before >= own) if strict else (before > own)
    inside = dealt.withColumn("bad", wrong(F.lag(row).over(w), row)).filter("bad").select("archive", order, *key)
    edges = dealt.groupBy("archive", "part").agg(F.min_by(F.struct(F.col(order).alias("o"), row.alias("k")), order).alias("first"), F.max_by(row, order).alias("last"))
    before = F.lag("last").over(Window.partitionBy("archive").orderBy("part"))
    between = edges.withColumn("bad", wrong(before, F.col("first.k"))).filter("bad").select("archive", F.col("first.o").alias(order), *[F.col(f"first.k.{k}").alias(k) for k in key])
    return inside.unionByName(between)


def bound_problems(entries: DataFrame, column: str, bound: Column) -> DataFrame:
    return entries.filter((F.col(column) < 0) | (F.col(column) >= bound)).select("archive", "idx", column)


def first_problem(checks: dict[str, DataFrame]) -> DataFrame:
    """(archive, check, first_idx, n) over check name -> problem rows with an idx."""
    rows = [df.select("archive", F.lit(name).alias("check"), F.col("idx").cast("long").alias("idx")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("archive", "check").agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"))


def catalogue(entries: DataFrame) -> DataFrame:
    """Counts of an archive's entries by kind of content."""
    html = F.col("mime").startswith("text/html")
    media = F.col("mime").rlike("^(image|video|audio)/")
    return entries.groupBy("archive").agg(F.count(F.lit(1)).alias("entry_count"), F.count_if(html).alias("html_count"), F.count_if(media).alias("media_count"), F.count_if(F.col("kind") == "redirect").alias("redirect_count"))


def unique_names(archives: DataFrame) -> DataFrame:
    """archives (file, name): later archives of a name get `~2`, `~3`... in file order."""
    k = F.row_number().over(Window.partitionBy("name").orderBy("file"))
    return archives.withColumn("unique_name", F.when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("~"), k)))
