"""What plans must look like, whatever the size of the tables."""

import re

from pyspark.sql import functions as F

from quarry import storage
from quarry.operators import entries, federated, index, score


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_redirects_do_not_double_the_plan(spark):
    nodes = storage.materialise(spark.range(200).select("id", F.when(F.col("id") % 5 > 0, F.col("id") - 1).alias("target")), "nodes")
    out = entries.resolve_redirects(nodes)
    assert plan(out).count("FileScan") <= 4
    assert out.filter("final is null").count() == 0 and out.agg(F.max("hops")).first()[0] == 4


def test_lists_are_cut_before_the_shuffle(spark):
    hits = storage.materialise(spark.range(1000).select(F.lit("a").alias("archive"), F.col("id").alias("doc_id"), (F.col("id") % 97).cast("double").alias("weight"), (F.col("id") % 3 == 0).alias("all")), "hits")
    p = plan(federated.candidates(hits, 10))
    assert len(re.findall(r"WindowGroupLimit.*Partial", p)) >= 2


def test_a_text_is_cut_once(spark):
    docs = storage.materialise(spark.createDataFrame([("a", 1, "of the of"), ("b", 2, "the")], "archive string, doc_id long, text string"), "docs")
    out = score.scan_matches(docs, ["of", "the"]).filter(F.exists("wdf", lambda x: x > 0)).select("doc_id", "wdf")
    assert plan(out).count("regexp_extract_all") <= 2  # the generator and its rendering in the node's arguments
    assert sorted(map(tuple, out.collect())) == [(1, [2, 1]), (2, [0, 1])]


def test_lookups_prune_files_and_columns(spark, tmp_path):
    rows = [(a, i, f"w{i} common " * 3) for a in ("x", "y") for i in range(50)]
    index.write_index(spark.createDataFrame(rows, "archive string, doc_id long, text string"), str(tmp_path))
    posts = spark.read.parquet(f"{tmp_path}/postings").filter("archive = 'x'").filter(F.col("term").isin("w3", "common"))
    p = plan(posts.select("doc_id", "wdf"))
    assert "PartitionFilters: [isnotnull(archive" in p and "In(term" in p and "positions" not in p.split("ReadSchema")[1]
    assert posts.count() == 51


def test_order_checks_of_one_archive_use_several_tasks(spark):
    e = spark.range(5000).select(F.lit("a").alias("archive"), F.col("id").alias("idx"), F.when(F.col("id").isin(17, 4000), "").otherwise(F.format_string("%06d", "id")).alias("path"))
    found = entries.order_problems(storage.materialise(e, "e"), ["path"])
    assert sorted(r.idx for r in found.collect()) == [17, 4000]
    assert "hashpartitioning(part" in plan(found) or "part" in plan(found)


def test_small_tables_are_spread(spark):
    small = storage.materialise(spark.range(10).coalesce(1), "small")
    assert storage.spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(1 << 40)
    assert storage.spread(large) is large
