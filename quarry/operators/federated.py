"""Federated search: scoring over all archives in one plan, then fusion by window functions over a few rows an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import columns as C
from quarry.operators import score


def depth_of(offset: int, limit: int) -> int:
    return min(500, max(10, offset + limit))


def candidates(hits: DataFrame, depth: int) -> DataFrame:
    """(archive, doc_id, weight, in_and, rank, strength) of each archive's best AND hits, and of its best hits of some terms only.

    hits: archive, doc_id, weight, all. Each list is cut by a window of its own, with a plain bound that tasks apply before the shuffle.
    Strength is of the list's greatest weight over all archives.
    """
    together = score.top_k(hits.filter("all"), depth)
    some = score.top_k(hits, depth).filter(~F.col("all")).drop("rank")
    ranked = together.unionByName(score.top_k(some, depth))
    best = F.max("weight").over(Window.partitionBy("all"))
    strength = F.when(best > 0, F.least(F.col("weight") / best, F.lit(1.0))).otherwise(0.0)
    return ranked.select("archive", "doc_id", "weight", F.col("all").alias("in_and"), "rank", strength.alias("strength"))


def fused(cands: DataFrame, weight: Column = None, boost: Column = None) -> DataFrame:
    """candidates() with `fused`, the reciprocal-rank share of each archive's vote: for the rank, for strength, and for a title's boost."""
    weight = F.lit(1.0) if weight is None else weight
    strength = F.col("strength") * 0.75
    return cands.withColumn("fused", C.rrf(F.col("rank"), weight, strength if boost is None else strength + boost))


def federated_search(docs: DataFrame, terms: list[str], offset: int = 0, limit: int = 10, or_fallback: bool = True, min_score: float | None = None, weight: Column = None) -> DataFrame:
    """One page: rank, archive, doc_id, score (4 digits) and partial. AND hits come first; hits of some terms follow if those run out."""
    cands = candidates(score.scored(docs, terms), depth_of(offset, limit))
    return page_of(fused(cands, weight), offset, limit, or_fallback and len(set(terms)) > 1, min_score)


def page_of(hits: DataFrame, offset: int, limit: int, or_fallback: bool, min_score: float | None = None) -> DataFrame:
    """One page of fused() candidates of all archives."""
    whole = Window.partitionBy(F.lit(1))  # at most 2 * depth rows an archive
    hits = hits.withColumn("n_and", F.count_if("in_and").over(whole))
    if not or_fallback:
        hits = hits.filter("in_and")
    else:
        hits = hits.filter(F.col("in_and") | (F.col("n_and") < offset + limit))
    best = F.max("fused").over(Window.partitionBy("in_and"))
    scale = F.when(F.col("in_and"), 1.0).when(F.col("n_and") > 0, 0.5).otherwise(1.0)
    hits = hits.withColumn("score", F.round(F.col("fused") / best * scale, 4))
    if min_score is not None:
        hits = hits.filter(F.col("score") >= min_score)
    order = Window.orderBy(F.desc("in_and"), F.desc(F.round("fused", 9)), "archive", "rank")
    page = hits.withColumn("place", F.row_number().over(order)).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return page.select(F.col("place").alias("rank"), "archive", "doc_id", "score", (~F.col("in_and")).alias("partial"))


def verified(page: DataFrame, fits: Column, limit: int) -> DataFrame:
    """Of a window of a ranked list (with what `fits` reads), the first `limit` rows that fit, and `next`: the last place looked at.

    A page that is full ends at its last row; one that is not has seen the whole window, and the next begins after it.
    """
    good = page.withColumn("fits", fits).withColumn("k", F.count_if("fits").over(Window.orderBy("rank")))
    full = F.min(F.when(F.col("fits") & (F.col("k") == limit), F.col("rank"))).over(Window.partitionBy(F.lit(1)))
    end = F.coalesce(full, F.max("rank").over(Window.partitionBy(F.lit(1))))
    return good.withColumn("next", end).filter(F.col("fits") & (F.col("k") <= limit)).drop("fits", "k")


def total_estimate(docs: DataFrame, terms: list[str]) -> DataFrame:
    t = score.totals(score.scored(docs, terms))
    return t.agg(F.sum(F.col("and_total") + F.greatest(F.lit(0), F.col("or_total") - F.col("and_total"))).alias("total_estimate"), F.sum("and_total").alias("and_total"))
