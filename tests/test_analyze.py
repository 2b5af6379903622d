from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import analyze as A
from quarry.functions import stemmers as S
from quarry.plans import registry


def test_accents():
    assert A.remove_accents("Ça Résumé Ångström 東京") == "ca resume angstrom 東京"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello, World!", "hello world"), ("AT&T isn't don’t", "at&t isn't don't"), ("3.14 1,000 v1.2.3", "3.14 1,000 v1.2.3"),
        ("C++ C# fish+chips A+++++", "c++ c# fish chips a"), ("snake_case api-trace2", "snake_case api trace2"), ("U.N.C.L.E. agent", "uncle agent"),
        ("U.NATO x.", "u nato x"), ("word\u200bbreak", "wordbreak"), ("  ... ", ""), ("東京都", "東 東京 京 京都 都"), ("go東京now", "go 東 東京 京 now"), ("3'4 a'4", "3 4 a'4"),
    ],
)
def test_words(text, want):
    assert A.tokenize(text) == want.split()


def test_words_without_ngrams():
    assert A.tokenize("東京都", ngrams=False) == ["東京都"]


@given(st.text(max_size=200))
def test_any_text(text):
    for w in A.tokenize(text):
        assert w and not any(c.isspace() for c in w)


@pytest.mark.parametrize(
    "language, pairs",
    [
        ("english", "running:run runners:runner ran:ran documentation:document repositories:repositori flies:fli dying:die hopping:hop hoping:hope relational:relat generously:generous skies:sky consignment:consign consistency:consist knightly:knight controlled:control agreed:agre news:news"),
        ("german", "aufeinander:aufeinand kategorien:kategori hauser:haus verbindungen:verbind freundlichkeit:freundlich"),
        ("spanish", "chicos:chic rapidamente:rapid torneado:torn cheques:chequ toreros:torer"),
        ("swedish", "jaktkarlarne:jaktkarl klostret:klostret kloster:klost"),
        ("danish", "undersogelse:undersog"),
        ("french", "continua:continu continuait:continu continuation:continu majestueusement:majestu majestueux:majestu main:main maintenir:mainten majeur:majeur chevaux:cheval nationaux:national"),
        ("italian", "abbandonata:abbandon abbandonava:abbandon abbandonerai:abbandon pronto:pront pronuncia:pronunc pronunciare:pronunc propaga:propag"),
        ("portuguese", "boa:boa boas:boas boba:bob boca:boc quilometros:quilometr quilombo:quilomb quimicos:quimic"),
        ("dutch", "lichaamsziek:lichaamsziek lichamelijk:licham lichamelijke:licham lichten:licht opgingen:opging opglimlachten:opglimlacht"),
        ("russian", "в:в вавиловка:вавиловк важная:важн важнее:важн важного:важн падает:пада падал:пада важно:важн"),
        ("norwegian", "havnedistriktene:havnedistrikt"),
    ],
)
def test_stems(language, pairs):
    for p in pairs.split():
        word, want = p.split(":")
        assert S.STEMMERS[language](word) == want, word


@given(st.sampled_from(sorted(S.STEMMERS)), st.text("abcdefghijklmnopqrstuvwxyz'éвшаяинсть", max_size=12))
def test_any_word(language, word):
    assert len(S.STEMMERS[language](word)) <= len(word) + 1


def test_terms():
    assert A.terms("The Documentation of Git's repositories", "eng,fra") == ["the", "document", "of", "git", "repositori"]
    assert A.terms("Running", "xx") == A.terms("Running") == ["running"] and A.terms("x" * 65) == [] and A.terms(None) == []
    assert A.partial_stem("running", "en") == "Zrun" and A.partial_stem("3com", "en") == "3com"


def test_columns(spark):
    df = spark.createDataFrame([("Running É", "en"), (None, "de"), ("Running", None)], "t string, l string")
    rows = df.select(A.index_terms(F.col("t"), F.col("l")).alias("a"), A.bare_words(F.col("t")).alias("b"), A.without_accents(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in rows] == [(["run", "e"], ["running", "e"], "running e"), ([], [], None), (["running"], ["running"], "running")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Quay", "ÉTÉ", "c++", "a.b", "1.5", "it's", ".5,", "水路", "Σας", "x_y", "U.S.A.", "&", "é", "​", " ", "\n", "\x85", "\xa0", "#", "."]), max_size=12).map("".join))
def test_no_rule_looks_over_white_space(text):
    assert A.terms(text) == [w for w in A.tokenize(A.remove_accents(text)) if len(w.encode()) <= A.MAX_BYTES]
    assert A.term_counts(text) == dict(Counter(A.terms(text)))


ROWS = [("a", 1, "Quay quay mole", "en"), ("b", 2, "mole", None), ("a", 3, None, "en"), ("a", 4, "Quay", "en")]


def test_terms_are_counted_without_bringing_documents_together(spark, tmp_path):
    spark.createDataFrame([(i, t, a) for a, i, t, _ in ROWS], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["index_terms"](spark, str(tmp_path))
    assert "doc_id" not in df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert sorted(map(tuple, df.collect())) == [("a", "mole", 1, 1), ("a", "quay", 2, 3), ("b", "mole", 1, 1)]
    twice = spark.read.parquet(f"{tmp_path}/documents.parquet")
    twice.unionByName(twice).write.parquet(f"{tmp_path}/twice/documents.parquet")
    assert sorted(map(tuple, registry.queries()["index_terms"](spark, f"{tmp_path}/twice").collect())) == [("a", "mole", 1, 2), ("a", "quay", 2, 6), ("b", "mole", 1, 2)]


def test_words_without_a_stemmer_are_not_remembered_twice():
    A._Chunks.cache_clear()
    A._Stems.cache_clear()
    assert A.term_counts("Quay, quay mole " + "x" * 65) == {"quay": 2, "mole": 1} and not A._Stems(None)
    assert A.terms("Running runs", "en") == ["run", "run"] and A._Stems("en") == {"running": "run", "runs": "run"}
