"""A watched folder: documents that arrive as Parquet files are indexed once each.

The file source remembers what it has read in the checkpoint, and each batch writes to a folder of its own number, so a batch that
runs again after a failure replaces its own rows and adds none twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import index

SCHEMA = "archive string, doc_id long, text string"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts indexing what lies in folder, and with once=False whatever comes later."""

    def add(batch: DataFrame, number: int) -> None:
        index.postings(batch).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        index.doc_stats(batch).write.mode("overwrite").parquet(f"{out}/doc_stats/batch={number}")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_stats(spark: SparkSession, out: str) -> DataFrame:
    """Collection statistics of all that has been indexed so far."""
    return index.coll_stats(spark.read.parquet(f"{out}/doc_stats").withColumn("doclen", F.col("doclen").cast("long")))
