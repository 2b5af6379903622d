"""Index tables: tokens, postings and their statistics. Written once, sorted by term, they serve every later query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import storage
from quarry.functions.columns import simple_terms

KEYS = ["archive", "doc_id"]


def tokens(docs: DataFrame, terms=None) -> DataFrame:
    """(archive, doc_id, pos, term) of docs (archive, doc_id, text, ...)."""
    return storage.spread(docs).select("archive", "doc_id", F.posexplode(simple_terms(F.col("text")) if terms is None else terms).alias("pos", "term"))


def postings(docs: DataFrame, positions: bool = False, terms=None) -> DataFrame:
    """(archive, doc_id, term, wdf[, positions]). One shuffle, pre-aggregated in the map tasks unless positions are kept."""
    out = [F.count(F.lit(1)).alias("wdf")]
    if positions:
        out.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return tokens(docs, terms).groupBy(*KEYS, "term").agg(*out)


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("archive", "term").agg(F.count(F.lit(1)).alias("term_freq"), F.sum("wdf").alias("coll_freq"))


def doc_stats(docs: DataFrame, terms=None) -> DataFrame:
    """(archive, doc_id, doclen): documents without terms have length 0 and still count."""
    return storage.spread(docs).select(*KEYS, F.size(simple_terms(F.col("text")) if terms is None else terms).cast("long").alias("doclen"))


def coll_stats(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("archive").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"), F.sum("doclen").alias("total_doclen"), F.avg("doclen").alias("avg_doclen"), F.min("doclen").alias("min_doclen"), F.max("doclen").alias("max_doclen")
    )


def terms_with_prefix(stats: DataFrame, prefix: str, limit: int | None = None) -> DataFrame:
    """Terms by byte prefix; with a limit the most frequent, ties by term."""
    found = stats.filter(F.col("term").startswith(prefix)) if prefix else stats
    return found.orderBy(F.desc("term_freq"), "term").limit(limit) if limit else found.orderBy("archive", "term")


def write_index(docs: DataFrame, folder: str, terms=None, per_file: int = 20_000_000) -> None:
    """Persists the tables, partitioned by archive and sorted by term, so that lookups prune files and row groups.

    docs: archive, doc_id, text, or `terms`, a column of index terms. An archive's postings are cut by ranges of terms into files of
    about per_file postings, as many as its size asks for, so that a large archive is no single task's work.
    """
    spark = docs.sparkSession
    lengths = doc_stats(docs, terms)
    lengths.write.partitionBy("archive").mode("overwrite").parquet(f"{folder}/doc_stats")
    lengths = spark.read.parquet(f"{folder}/doc_stats")
    total = lengths.agg(F.coalesce(F.sum("doclen"), F.lit(0))).first()[0]
    files = max(1, -(-total // per_file), spark.sparkContext.defaultParallelism)
    posts = postings(docs, positions=True, terms=terms)
    posts.repartitionByRange(files, "archive", "term", "doc_id").sortWithinPartitions("archive", "term", "doc_id").write.partitionBy("archive").mode("overwrite").parquet(f"{folder}/postings")
    stats = term_stats(spark.read.parquet(f"{folder}/postings"))
    stats.repartitionByRange(files, "archive", "term").sortWithinPartitions("archive", "term").write.partitionBy("archive").mode("overwrite").parquet(f"{folder}/term_stats")
    coll_stats(lengths).write.mode("overwrite").parquet(f"{folder}/coll_stats")
