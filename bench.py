"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quarry.plans import registry

HEADLINE = [
    "federated_search", "bm25_and_topk", "bm25_index_or_topk", "term_stats", "postings_wdf", "collection_stats", "percent_fulltext", "prefix_expand_top100",
    "phrase_adjacent", "page_links", "links_resolved", "redirect_resolve", "context_pack", "entries_scan", "md5_content", "render_markdown_pages", "phrase_verified_page",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, times = registry.queries(), {}
    for name in HEADLINE:
        if name not in found:
            continue
        best = None
        for _ in range(2):  # the first run compiles
            t = time.perf_counter()
            found[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.perf_counter() - t)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
