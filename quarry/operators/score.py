"""Full-text evaluation over many archives at once: an archive is a column, not a loop."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions import columns as C


def fold_query(terms: list[str]) -> list[tuple[str, int]]:
    """Distinct terms in first-seen order with their counts in the query."""
    return list(Counter(terms).items())


def _occurrences(term: str) -> Column:
    return F.size(F.filter("t.own", lambda x: x == F.lit(term))).cast("long")


def scan_matches(docs: DataFrame, terms: list[str], own: Column | None = None) -> DataFrame:
    """(archive, doc_id, doclen, wdf array) of every document, in one scan that cuts each text once. `own` may name a column of index terms.

    The terms pass through a generator, which neither filters nor projections are moved across, so the text is not cut again for each use.
    """
    own = C.simple_terms(F.col("text")) if own is None else own
    cut = storage.spread(docs).select("archive", "doc_id", F.explode(F.array(F.struct(own.alias("own")))).alias("t"))
    count = [_occurrences(t) for t, _ in fold_query(terms)]
    wide = cut.select("archive", "doc_id", F.explode(F.array(F.struct(F.size("t.own").cast("long").alias("doclen"), F.array(*count).alias("wdf")))).alias("m"))
    return wide.select("archive", "doc_id", "m.doclen", "m.wdf")


def archive_stats(matches: DataFrame, n_terms: int) -> DataFrame:
    """Collection size, mean length and term frequencies by archive: one row each, aggregated in the map tasks."""
    tf = [F.sum((F.col("wdf")[k] > 0).cast("long")).alias(f"tf{k}") for k in range(n_terms)]
    return matches.groupBy("archive").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doclen").alias("avg_doclen"), *tf)


def scored(docs: DataFrame, terms: list[str], own: Column | None = None) -> DataFrame:
    """(archive, doc_id, doclen, matched, weight) of documents with any query term; `all` marks those with all of them."""
    query = fold_query(terms)
    matches = storage.materialise(scan_matches(docs, terms, own), "matches")  # a few dozen bytes a document, used twice
    stats = archive_stats(matches, len(query)).withColumnRenamed("archive", "a")
    hits = matches.filter(F.exists("wdf", lambda x: x > 0)).join(stats, F.col("archive") == F.col("a"))
    weight, matched = F.lit(0.0), F.lit(0)
    for k, (_, wqf) in enumerate(query):
        wdf, tf = F.col("wdf")[k], F.col(f"tf{k}")
        w = C.term_weight(F.col("n_docs"), tf, F.lit(wqf))
        weight = weight + F.when(wdf > 0, C.doc_part(w, wdf, F.col("doclen"), F.col("avg_doclen"))).otherwise(0.0)
        matched = matched + (wdf > 0).cast("int")
    return hits.select("archive", "doc_id", "doclen", matched.alias("matched"), weight.alias("weight")).withColumn("all", F.col("matched") == len(query))


def scored_from_index(posts: DataFrame, lengths: DataFrame, terms: list[str], coll: DataFrame | None = None) -> DataFrame:
    """As scored(), from index tables: only the query's posting lists are read, then joined with the lengths of their documents.

    coll: (archive, n_docs, avg_doclen), counted from the lengths where it is not given.
    """
    query = fold_query(terms)
    spark = posts.sparkSession
    if coll is None:
        coll = lengths.groupBy("archive").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("doclen").alias("avg_doclen"))
    q = spark.createDataFrame(query, "term string, wqf int")  # as many rows as the query has terms
    lists = posts.filter(F.col("term").isin([t for t, _ in query])).select("archive", "doc_id", "term", "wdf")
    tf = lists.groupBy("archive", "term").agg(F.count(F.lit(1)).alias("tf"))
    parts = lists.join(F.broadcast(q), "term").join(tf, ["archive", "term"]).join(lengths.select("archive", "doc_id", "doclen"), ["archive", "doc_id"], "left").join(coll.select("archive", "n_docs", "avg_doclen"), "archive")
    w = C.term_weight(F.col("n_docs"), F.col("tf"), F.col("wqf"))
    part = C.doc_part(w, F.col("wdf"), F.coalesce("doclen", F.lit(0)), F.col("avg_doclen"))
    out = parts.groupBy("archive", "doc_id").agg(F.first("doclen").alias("doclen"), F.count(F.lit(1)).cast("int").alias("matched"), F.sum(part).alias("weight"))
    return out.withColumn("all", F.col("matched") == len(query))


def top_k(hits: DataFrame, k: int, key: str = "weight") -> DataFrame:
    """The k best of each archive, ties by doc_id, ranked from 0; weights are compared to 9 digits, so engines agree.

    The bound on the row number is pushed into the window as a group limit: each task keeps k rows an archive before the shuffle.
    """
    w = Window.partitionBy("archive").orderBy(F.desc(F.round(key, 9)), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def percent(hits: DataFrame, n_terms: int) -> DataFrame:
    """Percent of the best hit of an archive, scaled by its matched terms, cut and at least 1. The best hits are one row an archive."""
    best = hits.groupBy(F.col("archive").alias("a")).agg(F.max_by(F.struct("weight", "matched"), F.struct(F.round("weight", 9), -F.col("doc_id"))).alias("best"))
    raw = F.col("weight") * (F.col("best.matched") / F.lit(float(n_terms))) * 100 / F.col("best.weight") + 100 * 2.220446049250313e-16
    joined = hits.join(best, F.col("archive") == F.col("a"))
    return joined.select(*hits.columns, F.greatest(F.floor(F.round(raw, 9)).cast("int"), F.lit(1)).alias("percent"))


def title_percent(hits: DataFrame) -> DataFrame:
    """Percent of title hits: of the best weight of the archive, between 1 and 100; 0 where there is no weight."""
    best = hits.groupBy(F.col("archive").alias("a")).agg(F.max("weight").alias("best"))
    cut = F.least(F.greatest(F.floor(F.round(F.col("weight") / F.col("best") * 100, 9)).cast("int"), F.lit(1)), F.lit(100))
    return hits.join(best, F.col("archive") == F.col("a")).select(*hits.columns, F.when((F.col("weight") > 0) & (F.col("best") > 0), cut).otherwise(0).alias("percent"))


def totals(hits: DataFrame) -> DataFrame:
    """Exact numbers of AND and OR matches of each archive."""
    return hits.groupBy("archive").agg(F.count_if("all").alias("and_total"), F.count(F.lit(1)).alias("or_total"))
