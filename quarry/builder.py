"""Builds a library's tables from archives: opening, entries, contents, documents, and the indexes of texts and titles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from quarry import storage
from quarry.functions import adapters, analyze, html
from quarry.functions import columns as C
from quarry.operators import entries, index, suggest
from quarry.sources import glass, zim

OPENED = "file string, archive string, error string, uuid string, size long, new_scheme boolean, main_idx long, has_fulltext boolean, has_title_index boolean, has_listing boolean, has_positions boolean, has_termlist boolean, fulltext_docs long, title_docs long"


def _flags(a: zim.Archive) -> tuple:
    """What an archive can do by itself: an index counts where it is stored uncompressed and opens."""
    found = {}
    for kind in ("fulltext", "title"):
        where = a.index_ranges(kind)
        if where is not None:
            try:
                found[kind] = glass.Database(where)
            except glass.GlassError:
                continue
    main = a.main_entry()
    docs = lambda kind: found[kind].stats["doc_count"] if kind in found else None
    positions = any(d.has("position") for d in found.values())
    return a.header.uuid, a.source.size, a.header.new_scheme, main[1] if main else None, "fulltext" in found, "title" in found, bool(a.title_order()), positions, any(d.has("termlist") for d in found.values()), docs("fulltext"), docs("title")


def opened(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each file, opened on the executors: what it is, or why it does not open."""
    labels = zim.labels(paths)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, label in zip(b["file"], b["label"], strict=True):
                try:
                    rows.append((p, label, None, *_flags(zim.Archive(p))))
                except (zim.ZimError, OSError) as e:
                    rows.append((p, label, str(e), *[None] * 11))
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in OPENED.split(", ")]).astype({"main_idx": "Int64", "size": "Int64", "fulltext_docs": "Int64", "title_docs": "Int64"})

    return storage.dealt(spark, [(p, labels[p]) for p in paths], "file string, label string").mapInPandas(run, OPENED)


def contents(items: DataFrame, paths: list[str]) -> DataFrame:
    """items (archive, cluster, blob, ...) with `content`. Rows travel to where their cluster is decoded, once; no blob is shuffled."""
    files = {label: p for p, label in zim.labels(paths).items()}
    spark = items.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = items.repartitionByRange(parts, "archive", "cluster").sortWithinPartitions("archive", "cluster", "blob")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = archive = at = blobs = None
        for b in batches:
            out = []
            for label, cluster, blob in zip(b["archive"], b["cluster"], b["blob"], strict=True):
                if label != name:
                    name, archive, at = label, zim.Archive(files[label]), None
                if cluster != at:
                    at, blobs = cluster, archive.cluster(int(cluster))
                out.append(blobs[int(blob)] if blob < len(blobs) else None)
            yield b.assign(content=out)

    return dealt.mapInPandas(run, StructType([*dealt.schema.fields]).add("content", BinaryType()))


def metadata(items: DataFrame, paths: list[str]) -> DataFrame:
    """(archive, meta map) of the M entries: a few dozen small values an archive."""
    rows = contents(items.filter("ns = 'M' and kind = 'item'").select("archive", "path", "cluster", "blob"), paths)
    return rows.groupBy("archive").agg(F.map_from_entries(F.collect_list(F.struct("path", F.make_valid_utf8(F.col("content").cast("string"))))).alias("meta"))


def archive_table(items: DataFrame, found: DataFrame, paths: list[str]) -> DataFrame:
    """A row for each archive: names, languages, counts, what it can do, layout, main page."""
    counts = entries.catalogue(items)
    wide = counts.join(found.filter("error is null").drop("error"), "archive").join(metadata(items, paths), "archive", "left")
    icon = F.col("path").rlike("^favicon(\\.png)?$") & F.col("ns").isin("-", "I", "C")
    wide = wide.join(items.filter(icon).groupBy("archive").agg(F.min_by(C.full_path(F.col("ns"), F.col("path")), F.struct("ns", "path")).alias("favicon")), "archive", "left")
    m = lambda k: F.col("meta")[k]
    stem = F.regexp_replace(F.regexp_extract("archive", r"([^/]*)$", 1), r"(?i)\.zim(aa)?$", "")
    name = C.sanitise_name(F.coalesce(F.nullif(F.trim(m("Name")), F.lit("")), stem))
    icons = F.array_sort(F.filter(F.map_keys("meta"), lambda k: k.startswith("Illustration_")))
    usual = F.filter(icons, lambda k: k.startswith("Illustration_48x48@1"))
    out = wide.select(
        "archive", name.alias("name"), *(m(k).alias(k.lower()) for k in "Title Description Language Creator Publisher Date Flavour Scraper".split()), C.parse_tags(F.coalesce(m("Tags"), F.lit(""))).alias("tags"),
        C.parse_counter(F.coalesce(m("Counter"), F.lit(""))).alias("counter"), F.coalesce(F.get(usual, F.lit(0)), F.get(icons, F.lit(0)), F.col("favicon")).alias("illustration"), *counts.columns[1:], *[c for c in found.columns if c not in ("archive", "error")],
    )
    unique = F.row_number().over(Window.partitionBy("name").orderBy("archive"))
    return out.withColumn("name", F.when(unique == 1, F.col("name")).otherwise(F.concat("name", F.lit("~"), unique))).withColumn("adapter", adapters.adapter_of(F.col("scraper"), F.col("name")))


def companions(pages: DataFrame, items: DataFrame) -> DataFrame:
    """pages with the place of the record that holds what a stub page shows, where its kind of archive has such records.

    `index/page_<id>` has `content/page_content_<id>.json`, and `index/<slug>` of a video archive `videos/<slug>.json`.
    """
    page_id, slug = F.regexp_extract("path", "^index/page_(.+)$", 1), F.regexp_extract("path", "^index/(.+)$", 1)
    want = F.when((F.col("adapter") == "libretexts") & (page_id != ""), F.concat(F.lit("content/page_content_"), page_id, F.lit(".json"))).when((F.col("adapter") == "youtube") & (slug != ""), F.concat(F.lit("videos/"), slug, F.lit(".json")))
    records = items.filter("kind = 'item'").select(F.col("archive").alias("r_archive"), F.col("ns").alias("r_ns"), F.col("path").alias("r_path"), F.col("cluster").alias("r_cluster"), F.col("blob").alias("r_blob"))
    same = (F.col("archive") == F.col("r_archive")) & (F.col("ns") == F.col("r_ns")) & (F.col("want") == F.col("r_path"))
    return pages.withColumn("want", want).join(records, same, "left").withColumn("record", F.col("r_path").isNotNull()).withColumn("cluster", F.coalesce("r_cluster", "cluster")).withColumn("blob", F.coalesce("r_blob", "blob")).drop("want", "r_archive", "r_ns", "r_path", "r_cluster", "r_blob")


def _subtitles(rows: DataFrame, items: DataFrame, paths: list[str]) -> DataFrame:
    """(archive, idx, vtt) of the video records among rows: their first subtitles, English before others."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    videos = rows.filter("record and adapter = 'youtube'").select("archive", "idx", "ns", html.subtitles_of(text).alias("want")).filter("want is not null")
    there = items.filter("kind = 'item' and path like 'videos/%.vtt'").select("archive", "ns", F.col("path").alias("want"), "cluster", "blob")
    found = contents(videos.join(there, ["archive", "ns", "want"]).select("archive", "idx", "cluster", "blob"), paths)
    return found.select(F.col("archive").alias("v_archive"), F.col("idx").alias("v_idx"), F.make_valid_utf8(F.col("content").cast("string")).alias("vtt"))


def documents(items: DataFrame, archives: DataFrame, paths: list[str]) -> DataFrame:
    """The rendered pages of all archives."""
    named = items.join(F.broadcast(archives.select("archive", "name", "adapter", "language", "new_scheme")), "archive")
    pages = named.filter(F.col("ns").isin("C", "A") & (F.col("kind") == "item") & F.col("mime").rlike("^(text/(html|plain|markdown)|application/(xhtml|json))"))
    pages = companions(pages, items)
    rows = contents(pages.select("archive", "idx", "ns", "path", "title", "mime", "name", "adapter", "language", "new_scheme", "record", "cluster", "blob"), paths)
    vtt = _subtitles(rows, items, paths)
    rows = rows.join(vtt, (F.col("archive") == F.col("v_archive")) & (F.col("idx") == F.col("v_idx")), "left")
    mime = F.when(F.col("record"), F.lit("application/json")).otherwise(F.col("mime"))
    text, title = html.capped(F.col("content"), 1 << 30), C.display_title(F.col("title"), F.col("path"))
    doc = html.document(text, mime, F.col("adapter"), F.col("ns"), F.col("path"), F.concat(F.lit("zim://"), F.col("name"), F.lit("/")), F.when(F.col("record"), title), F.col("vtt"))
    out = rows.select(F.col("name").alias("archive"), F.col("idx").alias("doc_id"), "ns", "path", title.alias("title"), "language", "new_scheme", doc.alias("d")).filter("d is not null")
    return out.select("archive", "doc_id", "ns", "path", "title", "language", "new_scheme", "d.markdown", "d.text", "d.sections", "d.links")


def write_documents(docs: DataFrame, folder: str) -> None:
    """The documents with their index terms; the index of their terms, and that of their titles by their own language."""
    spark = docs.sparkSession
    terms = analyze.index_terms(F.concat_ws("\n", "title", "text"), F.col("language"))
    docs.withColumn("terms", terms).write.partitionBy("archive").mode("overwrite").parquet(f"{folder}/documents")
    written = spark.read.parquet(f"{folder}/documents")
    index.write_index(written.select("archive", "doc_id", "terms"), f"{folder}/index", F.col("terms"))
    titles = suggest.title_index(written.select("archive", "doc_id", "title", "language"), language=F.col("language"))
    titles.write.partitionBy("archive").mode("overwrite").parquet(f"{folder}/titles")


def build(spark: SparkSession, paths: list[str], folder: str) -> list[dict]:
    """Writes the tables of a library; returns the failures, of which there is one for each file that does not open."""
    zim.register(spark)
    opened(spark, paths).write.mode("overwrite").parquet(f"{folder}/opened")
    found = spark.read.parquet(f"{folder}/opened")
    good = [r.file for r in found.filter("error is null").select("file").orderBy("file").collect()]
    if not good:
        raise zim.ZimError("no archive opens")
    items = storage.materialise(spark.read.format("zim").option("path", ",".join(good)).load(), "entries")  # each directory is decoded once
    archive_table(items, found, good).write.mode("overwrite").parquet(f"{folder}/archives")
    archives = spark.read.parquet(f"{folder}/archives")
    named = items.join(F.broadcast(archives.select("archive", "name")), "archive").drop("archive").withColumnRenamed("name", "archive")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    named.repartitionByRange(parts, "archive", "ns", "path").sortWithinPartitions("archive", "ns", "path").write.partitionBy("archive").mode("overwrite").parquet(f"{folder}/entries")
    write_documents(documents(items, archives, good), folder)
    storage.release(items)
    return [{"file": r.file, "error": r.error} for r in found.filter("error is not null").orderBy("file").collect()]
