"""Checks of archives as Spark jobs: each returns rows (file, check, place, message), and a report keeps the first of each check.

Archives are cut into ranges of entries, title positions or clusters; a range is a task, or of very many archives each small one is. Order is compared inside a range and over
its first edge, so no check needs a whole archive in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import storage
from quarry.sources import zim

PROBLEM = "file string, check string, place long, message string"
QUICK = ["entry_pointers", "entry_order", "title_order", "cluster_pointers", "mime_types"]
FULL = [*QUICK, "clusters", "checksum"]
_STEP = {"clusters": 64, "checksum": 1 << 62}


def _size(a: zim.Archive, check: str) -> int:
    if check == "title_order":
        return len(a.title_order())
    if check == "checksum":
        return 1
    return a.header.cluster_count if check.startswith("cluster") else a.header.entry_count


def _entry_pointers(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    for i, at in enumerate(a.pointers(a.header.path_ptr, lo, hi), lo):
        if not 80 <= at < a.source.size - 12:
            yield i, f"entry {i} at {at} is outside the archive"


def _entry_order(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    before = None
    for e in a.entries(max(0, lo - 1), hi):
        key = e[2].encode("latin-1"), e[3].encode("utf-8", "replace")
        if before is not None and before >= key:
            yield e[1], f"entry {e[1]} is not after the one before"
        before = key


def _title_order(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    before = None
    for position, idx in enumerate(a.title_order()[max(0, lo - 1) : hi], max(0, lo - 1)):
        e = a.entry(idx)
        key = e[2].encode("latin-1"), (e[4] or e[3]).encode("utf-8", "replace")
        if before is not None and before > key:
            yield position, f"title {position} is before the one before it"
        before = key


def _cluster_pointers(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    for i, at in enumerate(a.pointers(a.header.cluster_ptr, lo, hi), lo):
        if not 80 <= at < (a.header.checksum_ptr or a.source.size):
            yield i, f"cluster {i} at {at} is outside the archive"


def _mime_types(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    for e in a.entries(lo, hi):
        if e[5] == "item" and e[6] is None:
            yield e[1], f"entry {e[1]} has a type outside the list of {len(a.mimes)}"
        elif e[5] == "item" and e[7] >= a.header.cluster_count:
            yield e[1], f"entry {e[1]} is in cluster {e[7]} of {a.header.cluster_count}"


def _clusters(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    for k in range(lo, hi):
        try:
            a.cluster(k)
        except Exception as e:  # whatever a broken stream raises is what this check looks for
            yield k, f"cluster {k}: {e}"


def _checksum(a: zim.Archive, lo: int, hi: int) -> Iterator[tuple[int, str]]:
    if a.checksum_ok() is False:
        yield 0, "the MD5 of the content is another"


_CHECKS = {"entry_pointers": _entry_pointers, "entry_order": _entry_order, "title_order": _title_order, "cluster_pointers": _cluster_pointers, "mime_types": _mime_types, "clusters": _clusters, "checksum": _checksum}


def check_range(a: zim.Archive, check: str, lo: int, hi: int) -> list[tuple[int, str]]:
    """The problems of one range; bytes that cannot be read at all are one as well."""
    try:
        return list(_CHECKS[check](a, lo, hi))
    except (zim.ZimError, IndexError) as e:
        return [(lo, f"{check} from {lo}: {e}")]


def _tasks(file: str, checks: list[str], step: int) -> list[tuple[str, int, int]]:
    """The ranges (check, lo, hi) of an archive."""
    a, out = zim.Archive(file), []
    for c in checks:
        try:
            n, own = _size(a, c), _STEP.get(c, step)
        except (zim.ZimError, IndexError):  # the check itself will say so
            n, own = 1, 1
        out += [(c, lo, min(n, lo + own)) for lo in range(0, n, own)]
    return out


def problems(spark: SparkSession, files: list[str], checks: list[str] = QUICK, step: int = 100_000) -> DataFrame:
    """All problems of the archives."""
    planned, rest = zim.packs(files)
    tasks = [(f, *t) for f in planned for t in _tasks(f, checks, step)] + [(f, "", 0, 0) for own in rest for f in own]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t in b.itertuples():
                for check, lo, hi in [(t.check, t.lo, t.hi)] if t.check else _tasks(t.file, checks, step):
                    found += [(t.file, check, *x) for x in check_range(zim.Archive(t.file), check, lo, hi)]
            yield pd.DataFrame(found, columns=["file", "check", "place", "message"]).astype({"place": "int64"})

    if not tasks:
        return spark.createDataFrame([], PROBLEM)
    if not rest:
        dealt = spark.createDataFrame(tasks, "file string, check string, lo long, hi long").repartition(min(len(tasks), 4096))
    else:
        dealt = storage.dealt(spark, tasks, "file string, check string, lo long, hi long")
    return dealt.mapInPandas(run, PROBLEM)


def report(found: DataFrame) -> DataFrame:
    """(file, check, place, message, n): the first problem of each check, and how many there are."""
    first = F.min(F.struct("place", "message")).alias("first")
    return found.groupBy("file", "check").agg(first, F.count(F.lit(1)).alias("n")).select("file", "check", "first.place", "first.message", "n")
