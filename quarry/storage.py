"""The shared folder, and tables written there to cut a plan's lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only a local master may do without (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    return found.rstrip("/")


#: Folders that this process made and has not deleted yet.
_MADE: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; deleted at the end of the process, or of the scope(), at the latest."""
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.unregister(_delete_all)
        atexit.register(_delete_all)
    _MADE[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    _MADE.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_all() -> None:
    for path, spark in list(_MADE.items()):
        if spark.sparkContext._jsc is None:  # the session has ended before the process: nothing can be reached any more
            return
        _delete(spark, path)


def release(*tables: DataFrame) -> None:
    """Deletes what materialise() wrote for these tables; only for tables on which nothing unwritten depends."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            _delete(t.sparkSession, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all scratch folders made within."""
    before = set(_MADE)
    yield
    for path in [p for p in _MADE if p not in before]:
        _delete(spark, path)


@contextmanager
def _without_its_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files: else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, per_file: int = 50_000) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors.

    rows: about how many there are at most, where that is known: few narrow rows of many tasks are dealt to few files then.
    The shuffle files of the writing are deleted at its end: nothing else reads them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    if rows is not None and rows // per_file + 1 < int(spark.conf.get("spark.sql.shuffle.partitions", "200")):
        df = df.repartition(rows // per_file + 1)
    with _without_its_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Below so many bytes a core, a table is spread before heavy work on it.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is small and the work on it is heavy: files of one row group are read by one task, however cut.

    The planner's own estimate decides, so nothing runs for it; a large table stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def dealt(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A list over a few tasks a core: the number of tasks does not grow with that of the rows."""
    return spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 8 * spark.sparkContext.defaultParallelism)))
