"""Very many small archives: neither tasks, nor what a task is sent, nor the driver's work may grow with their number."""

import pickle

import pytest
from pyspark.sql.datasource import EqualTo

from quarry import builder, integrity
from quarry.sources import glass, writing, zim

N = 600


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("many"), []
    for k in range(N):
        index = writing.database({b"quay": [(1, 1)]}, {1: b"C/p"}, {(b"quay", 1): [k + 1]})
        data = writing.archive([("C", "p", f"Page {k}", b"quay" * k), ("C", "r", "again", "p"), ("M", "Title", "", b"Book"), ("X", "fulltext/xapian", "", index)], [writing.NONE, writing.XZ, writing.ZSTD][k % 3], listing=True)
        out.append(f"{folder}/{k:04}.zim")
        with open(out[-1], "wb") as f:
            f.write(data[:-1] + bytes([data[-1] ^ (k == 7)]))
    return out


def reader(paths, table="entries", cls=zim.ZimReader, **more):
    return cls({"path": ",".join(paths), "table": table, **more})


def rows(r):
    sent = pickle.loads(pickle.dumps(r))  # as tasks get it
    return sorted(row for p in r.partitions() for row in sent.read(p))


def one_by_one(paths, table, cls=zim.ZimReader, **more):
    return sorted(row for p in paths for row in rows(reader([p], table, cls, **more)))


def test_archives_are_dealt_to_few_tasks(paths):
    alone, groups = zim.packs(paths)
    assert not alone and sorted(p for g in groups for p in g) == paths and len(groups) <= zim.LEAST + 1
    assert zim.packs(paths[: zim.PLANNED]) == (paths[: zim.PLANNED], [])
    assert len(pickle.dumps(reader(paths))) == len(pickle.dumps(reader(paths[:1])))
    assert rows(reader(paths)) == one_by_one(paths, "entries")


def test_a_filter_holds_in_archives_that_are_read_whole(paths):
    r = reader(paths)
    assert list(r.pushFilters([EqualTo(("ns",), "M")])) == []
    assert [x[2:4] for x in rows(r)] == [("M", "Title")] * N and len(r.partitions()) <= zim.LEAST + 1


def test_many_archives_are_opened_in_few_tasks(spark, paths):
    found = builder.opened(spark, [*paths, "/none.zim"])
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    got = found.collect()
    assert sorted(r.file for r in got if r.error is None and r.fulltext_docs == 1) == paths and [r.file for r in got if r.error] == ["/none.zim"]


def test_many_archives_are_checked_in_few_tasks(spark, paths):
    found = integrity.problems(spark, paths, integrity.FULL)
    assert found.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert [(r.file, r.check) for r in found.collect()] == [(paths[7], "checksum")]


def test_blobs_titles_and_indexes_of_archives_that_are_read_whole(paths):
    assert rows(reader(paths, "blobs")) == one_by_one(paths, "blobs") and rows(reader(paths, "titles")) == one_by_one(paths, "titles")
    for table in ("positions", "lengths", "documents"):
        r = reader(paths, table, glass.GlassReader, index="fulltext")
        assert len(r.partitions()) <= zim.LEAST + 1 and rows(r) == one_by_one(paths, table, glass.GlassReader, index="fulltext")
