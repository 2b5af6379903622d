"""The pipeline's filtering stages against brute force on small tables."""

import hashlib
import re

import corpus_pipeline
import public_tokenizers
import pytest
from quarry.llm import decontaminate, quality_knn
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def near_kept(rows):
    """One of each component of texts whose five-word shingles are alike in eight of ten: that of the least doc_id; without words all."""
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(rows)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {i for i in rows if top(i) == i}


def no_passage(rows, items):
    windows = set()
    for t in items:
        w = decontaminate.WORD.findall(low(t))
        windows |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        assert len(w) >= 13  # no item here is shorter than a window
    words = {i: decontaminate.WORD.findall(low(t)) for i, t in rows.items()}
    return {i for i, w in words.items() if not any(tuple(w[k : k + 13]) in windows for k in range(len(w) - 12))}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    rows, first = {r.doc_id: r.text for r in docs.collect()}, docs
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "quality":
            want = {r.doc_id for r in quality_knn.score(first, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
        if name == "exact_dedup":
            best = {}
            for i in sorted(rows):
                key = re.sub(r"[\x20\x09-\x0D]", "", rows[i] or "")
                if key not in best or len(rows[i] or "") > len(rows[best[key]] or ""):
                    best[key] = i
            want = set(best.values())
        if name == "near_dedup":
            want = near_kept(rows)
        if name == "decontamination":
            want = no_passage(rows, items)
        if name == "bpe":
            encoded = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows.items()}
            sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
            want = {(i, len(x), sha(",".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in encoded.items()}
            ids = {tuple(r) for r in docs.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
        else:
            assert docs.columns == first.columns
        assert ids == want, name
        rows = {i: t for i, t in rows.items() if name == "bpe" or i in ids}
    assert docs.count() == len(rows) > 0


def test_run_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, rows repeated as a whole, columns named as the operators name theirs, no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    good = docs.filter("text is not null and length(text) > 200").orderBy("doc_id").limit(1).first().text
    odd = [(None, good), (None, good), (7, None), (7, ""), (None, None), (8, good + " and some more words at its end"), (8, "x" * 70_000), (9, "word " * 20_000)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(more).selectExpr("doc_id", "text", "'a' AS root", "1 AS digest", "2L AS quarry_row", "3 AS row_key", "'b' AS quality", "4 AS score")
    for name, rows in (("some", every), ("none", every.limit(0))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES[:4]):
            f(spark, now, folder).write.parquet(f"{folder}/{k}")
            now = spark.read.parquet(f"{folder}/{k}")
            assert now.columns == every.columns, stage
        left = [(r.doc_id, r.text) for r in now.collect()]
        assert len(left) == len(set(left)) and (name == "some") == bool(left)
        assert corpus_pipeline.run(spark, folder).count() == len(left)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None, "q"), (2, "", "q"), (None, "  ", "q"), (3, "Fine words here.", "q"), (3, "Fine words here.", "q")], "doc_id long, text string, quality string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_knn.score(df, none).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_knn.score(df, some).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality_knn.score(df.limit(0), some).collect() == []


@pytest.mark.parametrize("text", ["A b.\nc", "LOUD!! LOUD!!", "é" * 9, "1 2 3"])
def test_features_are_rates(text):
    assert abs(quality_knn.features(text) - quality_knn.features(text)).sum() == 0 and quality_knn.features(text).any()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_knn.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.95
