import json

from quarry.__main__ import main
from quarry.operators import index
from quarry.streaming import ingest
from tests.test_library import ROWS
from tests.test_zim import build


def run(capsys, *args, spark=None):
    code = main([str(a) for a in args], spark)
    got = capsys.readouterr()
    return code, got.out, got.err


def test_one_archive(capsys, tmp_path):
    f = tmp_path / "a.zim"
    f.write_bytes(build(ROWS, 5))
    assert "entries: 8" in run(capsys, "info", f)[1] and "Name: fruit_en" in run(capsys, "info", f)[1] and "namespaces: C M" in run(capsys, "info", f)[1]
    assert run(capsys, "ls", f, "--ns", "C", "--prefix", "Apple_")[1] == "C/Apple_pie\tApple pie\ttext/html\n"
    assert len(run(capsys, "ls", f, "--limit", 2)[1].splitlines()) == 2 and len(run(capsys, "ls", f, "--limit", 0)[1].splitlines()) == 8
    assert run(capsys, "extract", f, "Apples", "--outline")[1] == "# Apple\n## Growing\n## Uses\n"
    assert run(capsys, "extract", f, "C/Banana", "--text")[1] == "A yellow fruit.\n\n"
    assert run(capsys, "check", f, "--checksum", "--clusters")[:2] == (0, "no problem\n")
    assert run(capsys, "extract", f, "Nothing")[0] == 1 and "redirect" in run(capsys, "cat", f, "Apples", "--no-follow")[2]
    assert run(capsys, "extract", f, "Apple", "--section", "grow", "--link-prefix", "zim://x/")[1].startswith("## Growing")
    assert "[Banana](zim://x/Banana)" in run(capsys, "extract", f, "Apple", "--link-prefix", "zim://x/")[1] and run(capsys, "extract", f, "Apple", "--section", "none")[0] == 1
    bad = bytearray(f.read_bytes())
    bad[-20] ^= 255
    f.write_bytes(bad)
    assert run(capsys, "check", f, "--checksum")[0] == 1


def test_library(capsys, tmp_path, spark):
    (tmp_path / "a.zim").write_bytes(build(ROWS, 5))
    out = tmp_path / "tables"
    assert run(capsys, "build", out, "--zim-dir", tmp_path, spark=spark)[0] == 0
    assert "zim://fruit_en/Banana" in run(capsys, "search", out, "yellow", spark=spark)[1]
    assert '"Growing"' in run(capsys, "article", out, "fruit_en", "Apple", "--max-chars", 5, "--json", spark=spark)[1]
    found = run(capsys, "search", tmp_path / "a.zim", "apple sugar", "--any", "-n", 1, "--offset", 1, "--time", "--json", spark=spark)
    assert found[0] == 0 and len(json.loads(found[1])["rows"]) == 1 and found[2].endswith(" s\n")
    assert run(capsys, "suggest", tmp_path, "app", spark=spark)[1].startswith("Apple (fruit_en)") and "fruit_en" in run(capsys, "archives", "--zim", tmp_path / "a.zim", spark=spark)[1]
    assert "checksum ok, 0 problems" in run(capsys, "health", out, "--verify", "full", spark=spark)[1]
    code, _, err = run(capsys, "links", out, "nothing", "x", spark=spark)
    assert code == 1 and err == "error: NoSuchArchive: nothing\n"


def test_watched_folder(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    frame = lambda rows: spark.createDataFrame(rows, ingest.SCHEMA)
    first, second = [("x", 1, "a b a"), ("x", 2, "")], [("x", 3, "b")]
    frame(first).write.parquet(src)
    ingest.watch(spark, src, out, check).awaitTermination()
    frame(second).write.mode("append").parquet(src)
    ingest.watch(spark, src, out, check).awaitTermination()
    got = spark.read.parquet(out + "/postings").select("archive", "doc_id", "term", "wdf").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, index.postings(frame(first + second)).collect()))
    s = ingest.live_stats(spark, out).first()
    assert (s.n_docs, s.total_doclen) == (3, 4)
