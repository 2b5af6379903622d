from pyspark.sql import functions as F

from quarry.functions import analyze
from quarry.functions import snippets as S
from quarry.functions import analyze
from quarry.operators import suggest as U


def finder(*query):
    return S.term_finder(list(query), "en")


def test_snippet_window():
    text = "Intro words go on. " * 20 + "The quick brown fox jumps over a lazy dog. " + "More words follow. " * 20
    out, n = S.snippet(text, finder("fox", "dog"), 60, ("**", "**"))
    assert n == 2 and "**fox**" in out and "**dog**" in out and len(out) <= 60 and out[0] == out[-1] == "…"
    assert S.snippet(text, finder("nothing"), 30)[1] == 0 and S.snippet(text, finder("nothing"), 30)[0].startswith("Intro words")
    assert S.snippet("", finder("a"), 10) == ("", 0) and S.snippet("?!", finder("a"), 1) == ("?", 0)
    assert len(S.snippet("x" * 50, finder("a"), 10)[0]) == 10
    assert S.snippet("a\n\n\n\nfox", finder("fox"), 40, None, one_line=False)[0] == "a\n\nfox"


def brute_best(text, find, budget):
    words = [(m.start(), m.end(), find(m.group())) for m in S._WORD.finditer(text)]
    return max((len({t for *_, t in words[i : j + 1] if t is not None}) for i in range(len(words)) for j in range(i, len(words)) if words[j][1] - words[i][0] <= budget or i == j), default=0)


def test_snippet_is_best():
    import random

    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["fox", "dog", "cat", "word", "longerword"]) for _ in range(30))
        find = finder("fox", "dog", "cat")
        size = rng.randint(5, 60)
        assert S.snippet(text, find, size)[1] == brute_best(text, find, max(1, size - 2))


def test_snippet_column(spark):
    df = spark.createDataFrame([("Running foxes", "en"), (None, "en"), ("Running", None)], "t string, l string")
    assert [r[0] for r in df.select(S.snippets(F.col("t"), "run fox", F.col("l"))).collect()] == ["**Running** **foxes**", None, "Running"]


def test_synonym_frequency():
    assert U.synonym_frequency([5], 10) == 5 and U.synonym_frequency([], 10) == 0
    assert U.synonym_frequency([2, 3], 10) == 4  # 2 + 3 - 0.6 = 4.4


def test_parse():
    assert U.parse("Running d", "en") == (["running", "d"], ["Zrun"], "d") and U.parse("Dogs.", "en") == (["dogs"], ["Zdog"], None) and U.parse(" ! ") == ([], [], None)


def test_suggest(spark):
    rows = [("x", 1, "Dogs and cats"), ("x", 2, "The dog"), ("x", 3, "Cat and dogs"), ("x", 4, "Birds"), ("y", 5, "Dogma"), ("y", 6, ""), ("x", 7, "Dogs")]
    titles = spark.createDataFrame(rows, "archive string, doc_id long, title string")
    index = U.title_index(titles, language="en").cache()
    lengths = U.title_lengths(index)
    got = {r.doc_id for r in U.suggest(index, lengths, "dog", "en").collect()}
    assert got == {1, 2, 3, 5, 7}  # by prefix; the stem of "Dogs" as well
    got = {(r.doc_id, r.weight) for r in U.suggest(index, lengths, "dogs.", "en").collect()}
    weights = dict(got)
    assert set(weights) == {1, 2, 3, 7} and weights[7] > weights[3] > weights[2]  # whole title, then the word as it is, then its stem
    best = U.ordered(U.suggest(index, lengths, "dogs an", "en"), titles, 10).collect()
    assert [r.doc_id for r in best] == [3, 1]  # "an" is no word of the index, so no phrase: equal weights, by title
    best = U.ordered(U.suggest(index, lengths, "dogs and", "en"), titles, 10).collect()
    assert [r.doc_id for r in best] == [1, 3]
    assert U.suggest(index, lengths, "...", "en").count() == 0 and U.suggest(index, lengths, "zzz", "en").count() == 0
    fused = U.federated_suggest(U.ordered(U.suggest(index, lengths, "dogma", "en"), titles, 10), "dogma").collect()
    assert [r.doc_id for r in fused] == [5]


def test_one_title_a_target(spark):
    titles = spark.createDataFrame([("x", 1, "Dog a", "T"), ("x", 2, "Dog b", "T"), ("x", 3, "Dog c", "")], "archive string, doc_id long, title string, target string")
    index = U.title_index(titles)
    got = U.ordered(U.suggest(index, U.title_lengths(index), "dog "), titles, 10).collect()
    assert [r.doc_id for r in got] == [1, 3]


def test_titles_without_an_index_are_cut_once(spark):
    rows = [("a", 1, "The weather, the w2"), ("a", 2, "the wet"), ("a", 2, "Wind"), ("b", 3, None), ("b", 4, "x" * 70 + " the Wé wé"), ("b", 5, "1871 waves the")]
    titles = spark.createDataFrame(rows, "archive string, doc_id long, title string").repartition(3)
    posts, lengths = U.gathered(titles, "the w", language="en")
    full = U.title_index(titles, analyze.bare_words(F.col("title")), "en")
    key = lambda r: str(r)
    assert sorted(map(tuple, posts.collect()), key=key) == sorted((tuple(r) for r in full.collect() if r.term in ("Zthe", "the", U.ANCHOR, "Zw") or (r.term or "").startswith("w")), key=key)
    assert sorted(map(tuple, lengths.collect())) == sorted(map(tuple, U.title_lengths(full).collect()))
    assert sorted(map(tuple, U.title_index(titles, language="en").collect()), key=key) == sorted(map(tuple, full.collect()), key=key)
    got, want = U.suggest(posts, lengths, "the w", "en"), U.suggest(full, U.title_lengths(full), "the w", "en")
    assert got.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    python = [p.count("Arrow") for p in (x._jdf.queryExecution().executedPlan().toString() for x in (posts, lengths))]
    assert python == [0, 0]
