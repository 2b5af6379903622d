import pytest

from quarry import library as L
from tests.test_zim import build

APPLE = b"<title>Apple</title><h1>Apple</h1><p>An apple is a fruit. <a href='Banana'>Banana</a> <a href='Missing'>gone</a> <a href='Banana#x'>again</a></p><h2>Growing</h2><p>Apples grow on apple trees in orchards.</p><h2>Uses</h2><p>Pies and juice.</p>"
ROWS = [
    ("C", "Apple", "Apple", APPLE), ("C", "Apple_pie", "Apple pie", b"<p>A pie of apples and sugar, a running joke.</p>"), ("C", "Apples", "Apples", "Apple"), ("C", "Banana", "Banana", b"<p>A yellow fruit.</p>"),
    ("M", "Title", "Title", b"Fruits"), ("M", "Name", "Name", b"fruit_en"), ("M", "Language", "Language", b"eng"), ("M", "Tags", "Tags", b"food;_category:test"),
]
OTHER = [("C", "Stein", "Stein", b"<p>Ein Stein und apple.</p>"), ("M", "Name", "Name", b"stein_de"), ("M", "Language", "Language", b"deu")]


@pytest.fixture(scope="module")
def lib(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lib")
    (d / "a.zim").write_bytes(build(ROWS, 5))
    (d / "b.zim").write_bytes(build(OTHER))
    (d / "c.zim").write_bytes(b"no archive")
    failures = L.build(spark, L.zim.discover([str(d)]), str(d / "tables"))
    assert [f["file"][-5:] for f in failures] == ["c.zim"]
    return L.Library(spark, str(d / "tables"), [("stein*", 0.5)])


def test_catalogue(lib):
    assert [r["name"] for r in lib.list_archives().rows] == ["fruit_en", "stein_de"]
    assert [r["name"] for r in lib.list_archives("FOOD").rows] == ["fruit_en"]
    assert lib.select(["FRUIT_EN,b"]) == ["fruit_en", "stein_de"] and lib.select(["s*"]) == ["stein_de"] and lib.select() == ["fruit_en", "stein_de"]
    with pytest.raises(L.NoSuchArchive):
        lib.select(["nothing"])
    assert "fruit_en: Fruits [eng], 8 entries" in L.render_archives(lib.list_archives())


def test_search(lib):
    page = lib.search("apples")
    assert {h["path"] for h in page.rows} == {"Apple", "Apple_pie", "Stein"} and page.rows[0]["path"] == "Apple"  # both languages cut the ending
    assert "**" in page.rows[0]["snippet"] and page.rows[0]["uri"] == "zim://fruit_en/Apple" and "Apple" in L.render_search(page)
    first = lib.search("fruit apple", limit=1)
    second = lib.search("fruit apple", limit=1, cursor=first.cursor)
    assert first.rows[0]["path"] == "Apple" and not first.rows[0]["partial"] and second.rows[0]["partial"]
    with pytest.raises(L.BadCursor):
        lib.search("other", cursor=first.cursor)
    with pytest.raises(L.Invalid):
        lib.search(' " " ')
    found = lib.search('"yellow fruit"')
    assert [h["path"] for h in found.rows] == ["Banana"] and lib.search('"fruit yellow"').rows == [] and found.cursor is None
    assert lib.search("apple", ["stein_de"]).rows[0]["path"] == "Stein"


def test_suggest(lib):
    rows = lib.suggest("app").rows
    assert [r["title"] for r in rows] == ["Apple", "Apple pie"] and L.render_suggest(L.Page(rows)).startswith("Apple (fruit_en)")
    with pytest.raises(L.Invalid):
        lib.suggest(" ")


def test_articles(lib):
    whole = lib.read_article("fruit_en", "Apples").rows[0]
    assert whole["content"].startswith("# Apple\n\nAn apple is a fruit. [Banana](zim://fruit_en/Banana)") and whole["next_offset"] is None
    cut = lib.read_article("fruit_en", "zim://fruit_en/Apple#x", max_chars=7).rows[0]
    assert cut["content"] == "# Apple" and cut["next_offset"] == 7 and [s["title"] for s in cut["outline"]] == ["Apple", "Growing", "Uses"]
    assert lib.read_article("fruit_en", "Apple pie", "text").rows[0]["content"] == "A pie of apples and sugar, a running joke.\n"
    assert lib.read_article("fruit_en", "Apple", section="grow").rows[0]["content"].startswith("## Growing")
    for bad in (("fruit_en", "Nothing"), ("fruit_en", "Apple", "markdown", 10, 0, "none")):
        with pytest.raises(L.NoSuchEntry):
            lib.read_article(*bad)
    assert [r["title"] for r in lib.outline("fruit_en", "Apple").rows] == ["Apple", "Growing", "Uses"]
    links = lib.links("fruit_en", "Apple").rows
    assert [(r["text"], r["path"], r["exists"]) for r in links] == [("Banana", "Banana", True), ("gone", "Missing", False)] and "(missing)" in L.render_links(L.Page(links))
    assert lib.read_resource("zim://stein_de/Stein?format=text") == "Ein Stein und apple.\n" and '"eng"' in lib.read_resource("zim://fruit_en")


def test_context_and_health(lib):
    page = lib.context("apple trees")
    assert page.rows[0]["section"] == "Growing" and page.rows[0]["source"] == "zim://fruit_en/Apple#Growing" and "orchards" in page.rows[0]["text"]
    assert L.render_context(page).startswith("## Apple (fruit_en) — Growing\n\n")
    for level, checksum in (("none", "skipped"), ("quick", "skipped"), ("full", "ok")):
        page = lib.health(verify=level)
        health = {r["name"]: r for r in page.rows}
        assert health["fruit_en"]["problems"] == [] and 0 < health["fruit_en"]["coverage"] <= 1 and health["fruit_en"]["checksum"] == checksum
        assert [f["file"][-5:] for f in page.more["failures"]] == ["c.zim"] and "coverage" in L.render_health(page)
    with pytest.raises(L.Invalid):
        lib.health(verify="much")


def test_small_functions():
    assert L.split_phrases('a "b c" d “e” "') == ("a b c d e", ["b c"])
    assert L.find_section(["Intro", "The end", "End"], "end") == 2 and L.find_section(["A"], "0") == 0 and L.find_section(["A"], "x") is None


def test_modes(lib):
    titles = lib.search("apple p", mode="title")
    assert [h["title"] for h in titles.rows] == ["Apple pie"] and titles.rows[0]["score"] == 1.0
    listed = lib.search("appl", ["fruit_en"], mode="listing")
    assert [h["title"] for h in listed.rows] == ["Apple", "Apple pie"] and {h["path"] for h in listed.rows} == {"Apple", "Apple_pie"} and listed.total == 2
    assert lib.search("apple", mode="fulltext").rows and lib.search("appl", mode="listing").more["warnings"] == []
    with pytest.raises(L.Invalid):
        lib.search("apple", mode="all")
    some = lib.search("fruit apple", any_words=True, limit=5)
    assert {h["partial"] for h in some.rows} == {False} and len(some.rows) > len([h for h in lib.search("fruit apple").rows if not h["partial"]])


def test_title_of_a_hit_is_the_stored_one(lib):
    assert {h["path"]: h["title"] for h in lib.search("sugar").rows} == {"Apple_pie": "Apple pie"}
    assert lib.search("apple", ["fruit_en"]).rows[0]["title"] == "Apple"  # a title equal to the query is worth a vote


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """An archive in which only every thirtieth page with two words has them side by side."""
    d = tmp_path_factory.mktemp("many")
    rows = [("C", f"p{k:03}", f"Page {k}", b"<p>" + (b"grey heron " if k % 30 == 29 else b"grey sky and heron ") * (1 + (k % 30 != 29)) + b"x " * (k % 7)) for k in range(90)]
    (d / "m.zim").write_bytes(build([*rows, ("C", "old", "old", "p001"), ("M", "Language", "", b"eng")], 5))
    L.build(spark, [str(d / "m.zim")], str(d / "t"))
    return L.Library(spark, str(d / "t"))


def test_phrases_go_on(many):
    seen, cursor, pages = [], None, 0
    while True:
        page = many.search('"grey heron"', limit=2, cursor=cursor)
        seen += [h["path"] for h in page.rows]
        pages, cursor = pages + 1, page.cursor
        if len(page.rows) < 2 and cursor:
            assert "cursor" in page.more["warnings"][0]
        if cursor is None:
            break
    assert sorted(seen) == ["p029", "p059", "p089"] and 2 <= pages <= 6


def test_main_page_of_the_header(many):
    e = many.resolve("m", "")  # the header names entry 0, a redirect
    assert e["path"] == "p001" and e["redirected"] and not many.resolve("m", "p002")["redirected"]


def test_links_follow_redirects(spark, tmp_path):
    rows = [("C", "a", "A", b"<p><a href=r1>one</a> <a href=gone>two</a> <a href=l1>loop</a> <a href=b>three</a>"), ("C", "r1", "", "r2"), ("C", "r2", "", "b"), ("C", "b", "Bee", b"<p>b"), ("C", "l1", "", "l2"), ("C", "l2", "", "l1")]
    (tmp_path / "x.zim").write_bytes(build(rows, 5))
    L.build(spark, [str(tmp_path / "x.zim")], str(tmp_path / "t"))
    lib = L.Library(spark, str(tmp_path / "t"))
    got = lib.links("x", "a").rows
    assert [(r["text"], r["path"], r["exists"], r["title"]) for r in got] == [("one", "b", True, "Bee"), ("two", "gone", False, None), ("loop", "l1", False, None), ("three", "b", True, "Bee")]
    assert lib.links("x", "a", limit=2).more["next_offset"] == 2 and [r["text"] for r in lib.links("x", "a", limit=2, offset=2).rows] == ["loop", "three"]
    article = lib.read_article("x", "r1")
    assert article.rows[0]["redirected_from"] == "r1" and "redirected from r1" in L.render_article(article)


def test_records_beside_stubs(spark, tmp_path):
    record = b'{"id": "v9", "title": "Knots", "description": "Ropes.", "subtitleList": [{"code": "en"}]}'
    video = [("C", "index/knots", "Knots", b"<p>loading"), ("C", "videos/knots.json", "", record), ("C", "videos/v9/video.en.vtt", "", b"WEBVTT\n\n00:00.000 --> 00:01.000\nbowline\n"), ("M", "Scraper", "", b"youtube2zim 3")]
    book = [("C", "index/page_5", "Five", b"<title>Page five</title>"), ("C", "content/page_content_5.json", "", b'{"htmlBody": "<p>Tides turn."}'), ("M", "Scraper", "", b"mindtouch2zim")]
    (tmp_path / "v.zim").write_bytes(build(video, 5))
    (tmp_path / "b.zim").write_bytes(build(book, 0))
    L.build(spark, [str(tmp_path / "v.zim"), str(tmp_path / "b.zim")], str(tmp_path / "t"))
    lib = L.Library(spark, str(tmp_path / "t"))
    assert "bowline" in lib.read_article("v", "index/knots").rows[0]["content"] and lib.search("bowline").rows[0]["path"] == "index/knots"
    assert lib.read_article("b", "index/page_5").rows[0]["content"] == "Tides turn.\n"
