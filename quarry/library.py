"""A library of archives: search, suggestion, articles, outlines, links, context and health over its tables.

All tables hold every archive; an archive is a column. What a method returns is one page, so it is collected; everything before
the page stays distributed. build() writes the tables once, partitioned by archive and sorted by term or path, and Library reads of
them what a request names: posting lists of the query's terms, never the texts of documents that are not on the page.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import builder, integrity
from quarry.builder import write_documents  # noqa: F401
from quarry.functions import analyze, snippets
from quarry.functions import columns as C
from quarry.operators import articles, entries, federated, score, suggest
from quarry.sources import zim


class LibraryError(Exception):
    """Any request that cannot be answered."""


class NoSuchArchive(LibraryError):
    pass


class EmptyLibrary(LibraryError):
    pass


class NoSuchEntry(LibraryError):
    pass


class BadCursor(LibraryError):
    pass


class Invalid(LibraryError):
    pass


@dataclass
class Page:
    """One page of rows, with whatever else a response tells."""

    rows: list[dict]
    total: int | None = None
    cursor: str | None = None
    more: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps({"rows": self.rows, "total": self.total, "cursor": self.cursor, **self.more}, ensure_ascii=False, default=str)


def build(spark: SparkSession, paths: list[str], folder: str) -> list[dict]:
    """Writes the tables of a library; returns the failures."""
    try:
        return builder.build(spark, paths, folder)
    except zim.ZimError as e:
        raise EmptyLibrary(str(e)) from e


# Queries ------------------------------------------------------------------------------------------------------------------

_QUOTED = re.compile("[\"“”„]([^\"“”„]*)[\"“”„]")


def split_phrases(query: str) -> tuple[str, list[str]]:
    """The words of a query without quotes, and its quoted phrases of two words or more."""
    phrases = [p.strip() for p in _QUOTED.findall(query) if len(p.split()) > 1]
    return " ".join(re.sub("[\"“”„]", " ", query).split()), phrases


def best_excerpt(markdown: str, sections: list[dict], find, per_hit: int) -> tuple[str, str | None]:
    """The part of an article that answers a query best: its lead or a section, and the section's title."""
    lead_end = min((s["start"] for s in sections), default=len(markdown))
    parts = [(None, 0, markdown[:lead_end])] + [(s["title"], s["level"], markdown[s["start"] : s["end"]].partition("\n")[2]) for s in sections]
    best = None
    for order, (title, level, body) in enumerate(parts):
        if not body.strip():
            continue
        text, n = snippets.snippet(body.strip(), find, per_hit, None, one_line=False)
        key = (n, level if n else 0, -order)
        if best is None or key > best[0]:
            best = key, text, title
    return (best[1], best[2]) if best else ("", None)


MODES = ("auto", "fulltext", "title", "listing")


class Library:
    """The eight requests over the tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str, priorities: list[tuple[str, float]] = (), full_verify: bool = True):
        read = lambda t: spark.read.parquet(f"{folder}/{t}")
        self.spark, self.priorities, self.full_verify = spark, list(priorities), full_verify
        self.archives, self.entries, self.documents, self.titles = read("archives"), read("entries"), read("documents"), read("titles")
        self.postings, self.lengths, self.collections, self.opened = read("index/postings"), read("index/doc_stats"), read("index/coll_stats"), read("opened")
        # What build() indexed counts as an archive's index, whether the archive brings one of its own or not.
        has = self.collections.select(F.col("archive").alias("c"), F.col("n_docs").alias("indexed_docs"))
        able = self.archives.join(has, F.col("name") == F.col("c"), "left").drop("c")
        listed = self.entries.filter(F.col("ns").isin(entries.CONTENT)).groupBy(F.col("archive").alias("l")).agg(F.lit(True).alias("listed"))
        able = able.join(listed, F.col("name") == F.col("l"), "left").drop("l").withColumn("listed", F.coalesce("listed", F.lit(False)))
        indexed = F.coalesce(F.col("indexed_docs") > 0, F.lit(False))
        modes = [entries.search_mode(m, indexed, indexed, F.col("listed")).alias(f"mode_{m}") for m in MODES]
        self.rows = {r.name: r for r in able.select("*", *modes).orderBy("name").collect()}  # one row an archive
        if not self.rows:
            raise EmptyLibrary("the library has no archive")

    def select(self, patterns: list[str] = ()) -> list[str]:
        """Archives by name, then whatever the case, then by glob; lists may be split by commas. All where none is asked for."""
        wanted = [p.strip() for x in patterns for p in x.split(",") if p.strip()]
        found: set[str] = set()
        for p in wanted:
            low = [n for n, r in self.rows.items() if p.lower() in (n.lower(), r.archive.lower(), re.sub(r"\.zim(aa)?$", "", r.archive.lower()))]
            hit = [p] if p in self.rows else low or [n for n in self.rows if re.match(C.glob_regex(p), n)]
            if not hit:
                raise NoSuchArchive(p)
            found |= set(hit)
        return sorted(found) if wanted else sorted(self.rows)

    def list_archives(self, term: str | None = None) -> Page:
        a = self.archives
        if term:
            in_tag = F.exists("tags", lambda t: F.lower(t["key"]).contains(term.lower()) | F.coalesce(F.lower(t["value"]).contains(term.lower()), F.lit(False)))
            a = a.filter(C.matches_filter(term, *(F.col(c) for c in ("name", "title", "description", "language", "creator", "flavour"))) | in_tag)
        rows = [r.asDict(recursive=True) for r in a.orderBy("name").collect()]
        return Page(rows, len(rows))

    def _by_language(self, names: list[str]) -> dict[str | None, list[str]]:
        out: dict[str | None, list[str]] = {}
        for n in names:
            out.setdefault(self.rows[n].language, []).append(n)
        return out

    def _scored(self, names: list[str], query: str) -> DataFrame | None:
        """Scores of every document with a query term, from posting lists; the query is analysed in each archive's own language."""
        parts = []
        for language, own in self._by_language(names).items():
            terms, mine = analyze.terms(query, language), F.col("archive").isin(own)
            if terms:
                parts.append(score.scored_from_index(self.postings.filter(mine), self.lengths.filter(mine), terms, self.collections.filter(mine)))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _suggested(self, names: list[str], text: str, depth: int) -> DataFrame:
        titles, parts = self.documents.select("archive", "doc_id", "title"), []
        for language, own in self._by_language(names).items():
            mine = self.titles.filter(F.col("archive").isin(own))
            parts.append(suggest.ordered(suggest.suggest(mine, suggest.title_lengths(mine), text, language), titles, depth))
        return reduce(DataFrame.unionByName, parts)

    def _candidates(self, query: str, names: list[str], mode: str, depth: int, any_words: bool = False) -> tuple[DataFrame | None, DataFrame | None, list[str]]:
        """Candidates of all archives in the mode that serves each, the full-text scores, and warnings."""
        by_mode: dict[str | None, list[str]] = {}
        for n in names:
            by_mode.setdefault(self.rows[n][f"mode_{mode}"], []).append(n)
        warnings = [f"{n}: no {'search' if mode == 'auto' else mode} index, skipped" for n in by_mode.get(None, [])]
        scored = self._scored(by_mode["fulltext"], query) if "fulltext" in by_mode else None
        if scored is not None and any_words:
            scored = scored.withColumn("all", F.lit(True))
        parts = [federated.candidates(scored, depth)] if scored is not None else []
        other = []
        if "title" in by_mode:
            other.append(suggest.title_hits(self._suggested(by_mode["title"], query, depth)))
        if "listing" in by_mode:
            other.append(entries.listing(self.entries.filter(F.col("archive").isin(by_mode["listing"])), query.strip(), depth))
        parts += [x.select("archive", "doc_id", F.lit(0.0).alias("weight"), F.lit(True).alias("in_and"), "rank", "strength") for x in other]
        return (reduce(DataFrame.unionByName, parts) if parts else None), scored, warnings

    def _boosted(self, cands: DataFrame, names: list[str], query: str) -> DataFrame:
        """Candidates with a boost for titles that equal the query or have all its terms; titles are the directory's."""
        where = self.entries.select("archive", F.col("idx").alias("doc_id"), C.display_title(F.col("title"), F.col("path")).alias("title"))
        languages = self.archives.select(F.col("name").alias("n"), "language")
        rows = cands.join(where, ["archive", "doc_id"]).join(F.broadcast(languages), F.col("archive") == F.col("n")).drop("n")
        stems = F.when(F.lit(False), F.array().cast("array<string>"))
        for language in self._by_language(names):
            stems = stems.when(F.col("language").eqNullSafe(F.lit(language)), F.array(*map(F.lit, analyze.terms(query, language))).cast("array<string>"))
        all_there = (F.size(stems) > 0) & (F.size(F.array_except(stems, analyze.index_terms(F.col("title"), F.col("language")))) == 0)
        same = analyze.without_accents(F.trim(F.regexp_replace("title", r"\s+", " "))) == F.lit(analyze.remove_accents(" ".join(query.split())))
        return rows.withColumn("boost", F.when(same, 1.0).when(all_there, 0.5).otherwise(0.0)).drop("title", "language")

    def search(
        self, query: str, archives: list[str] = (), limit: int = 10, cursor: str | None = None, snippet_chars: int = 300, min_score: float | None = None, or_fallback: bool = True, mode: str = "auto", offset: int = 0, any_words: bool = False
    ) -> Page:
        """One page over all chosen archives, with snippets.

        mode: auto takes for each archive the first of full text, titles and listing that it has; archives that lack a mode asked for
        are named in the warnings. any_words: documents with any of the words count in full, without a first list of those with all.
        Quoted phrases are verified on a window of candidates; where the page stays short of `limit` and candidates are left, the
        cursor goes on behind the last one looked at.
        """
        plain, phrases = split_phrases(query)
        if not plain:
            raise Invalid("empty query")
        if mode not in MODES:
            raise Invalid(f"unknown mode {mode}")
        names, limit = self.select(archives), min(50, max(1, limit))
        tag = hashlib.sha256(json.dumps([query, names, or_fallback, min_score, mode, any_words]).encode()).hexdigest()[:16]
        offset = self._offset(cursor, tag) if cursor else offset
        size = limit if not phrases else min(200, max(20, 10 * limit))
        cands, scored, warnings = self._candidates(plain, names, mode, federated.depth_of(offset, size + bool(phrases)), any_words)
        if cands is None:
            return Page([], 0, None, {"warnings": warnings, "phrases": phrases})
        hits = federated.fused(self._boosted(cands, names, plain), C.priority(F.col("archive"), self.priorities), F.col("boost"))
        several = or_fallback and len(plain.split()) > 1
        ranked = federated.page_of(hits, offset, size + 1, several, min_score)  # one more, to see whether the list goes on
        rows = self._decorated(ranked).withColumn("last", F.max("rank").over(Window.partitionBy(F.lit(1))))
        page = federated.verified(rows.filter(F.col("rank") <= offset + size), self._has_phrases(names, phrases), limit)
        shown = snippets.snippets(F.col("text"), plain, F.col("language"), snippet_chars) if snippet_chars else F.lit(None).cast("string")
        user = C.user_path(F.col("ns"), F.col("path"), F.coalesce("new_scheme", F.col("ns") == "C"))
        out = [r.asDict() for r in page.select("rank", "archive", user.alias("path"), C.uri(F.col("archive"), user).alias("uri"), "title", "score", "partial", shown.alias("snippet"), "doc_id", "next", "last").orderBy("rank").collect()]
        total = self._total(scored, several) + self._other_total(cands, names, mode)
        after, last = (out[0]["next"], out[0]["last"]) if out else (offset, offset)
        if phrases and not out:  # nothing in the window fits, but behind it something may
            last = ranked.agg(F.max("rank")).first()[0] or offset
            after = min(last, offset + size)
        if phrases and last > after and len(out) < limit:
            warnings.append(f"phrases were looked for in {after - offset} candidates; the cursor goes on behind them")
        rows = [{k: v for k, v in r.items() if k not in ("next", "last")} for r in out]
        return Page(rows, total, f"{tag}:{after}" if last > after else None, {"warnings": warnings, "phrases": phrases})

    def _decorated(self, page: DataFrame) -> DataFrame:
        """A page of hits with their documents; those without one, and all titles, come from the directory."""
        docs = self.documents.select("archive", "doc_id", "text", "terms", "language", "new_scheme")
        own = self.entries.select("archive", F.col("idx").alias("doc_id"), "ns", "path", C.display_title(F.col("title"), F.col("path")).alias("title"))
        return page.join(own, ["archive", "doc_id"]).join(docs, ["archive", "doc_id"], "left")

    def _has_phrases(self, names: list[str], phrases: list[str]):
        out = F.lit(True)
        for p in phrases:
            found = [F.col("language").eqNullSafe(F.lit(lang)) & C.contains_phrase(F.col("terms"), analyze.terms(p, lang)) for lang in self._by_language(names)]
            out = out & F.coalesce(reduce(lambda x, y: x | y, found), F.lit(False))
        return out

    def _total(self, scored: DataFrame | None, several: bool) -> int:
        if scored is None:
            return 0
        t = score.totals(scored).agg(F.sum("and_total").alias("a"), F.sum("or_total").alias("o")).first()
        return (t.o if several else t.a) or 0

    def _other_total(self, cands: DataFrame, names: list[str], mode: str) -> int:
        other = [n for n in names if self.rows[n][f"mode_{mode}"] in ("title", "listing")]
        return cands.filter(F.col("archive").isin(other)).count() if other else 0

    @staticmethod
    def _offset(cursor: str | None, tag: str) -> int:
        if cursor is None:
            return 0
        head, _, at = cursor.partition(":")
        if head != tag or not at.isdigit():
            raise BadCursor("the cursor is of another request")
        return int(at)

    def suggest(self, prefix: str, archives: list[str] = (), limit: int = 10) -> Page:
        if not prefix.strip():
            raise Invalid("empty prefix")
        hits = self._suggested(self.select(archives), prefix.strip(" "), federated.depth_of(0, limit))
        return Page([r.asDict() for r in suggest.federated_suggest(hits, prefix, min(50, max(1, limit))).collect()])

    def resolve(self, archive: str, path: str) -> dict:
        """The entry of a path: as it is, decoded, with underscores, then by title; redirects are followed."""
        (name,) = self.select([archive])
        own = self.entries.filter(F.col("archive") == name)
        path = re.sub(r"^zim://[^/]*/", "", path).partition("#")[0].lstrip("/")
        if not path and self.rows[name].main_idx is not None:
            found = own.filter(F.col("idx") == int(self.rows[name].main_idx)).take(1)
        else:
            keys = list(dict.fromkeys([path, unquote(path), unquote(path).replace(" ", "_")]))
            titles = list(dict.fromkeys([path, path.replace("_", " ")]))
            long = [(k[0], k[2:]) for k in keys if re.match("[^/]/.", k)]
            content = F.col("ns").isin("C", "A", "I", "J", "-")
            by_path = F.when(content & F.col("path").isin(keys), F.array_position(F.array(*map(F.lit, keys)), F.col("path")))
            for ns, rest in long:
                by_path = by_path.when((F.col("ns") == ns) & (F.col("path") == rest), 50)
            by_title = F.when(content & F.col("title").isin(titles), 100)
            found = own.withColumn("pri", F.coalesce(by_path, by_title)).filter("pri is not null").orderBy("pri", F.array_position(F.array(*map(F.lit, "CAIJ-")), F.col("ns")), "idx").take(1)
        hops = 0
        while found and found[0].kind == "redirect":
            hops += 1
            if hops > entries.MAX_HOPS:
                raise NoSuchEntry(f"{path}: too many redirects")
            found = own.filter(F.col("idx") == found[0].redirect_idx).take(1)
        if not found:
            raise NoSuchEntry(path)
        return found[0].asDict() | {"redirected": hops > 0, "archive": name}

    def _document(self, archive: str, path: str) -> DataFrame:
        e = self.resolve(archive, path)
        return self.documents.filter((F.col("archive") == e["archive"]) & (F.col("doc_id") == e["idx"]))

    def read_article(self, archive: str, path: str, form: str = "markdown", max_chars: int | None = 8000, offset: int = 0, section: str | None = None) -> Page:
        """A window of an article or of one section (all of it where max_chars is None); an outline where it is cut; where a redirect came from."""
        if form not in ("markdown", "text"):
            raise Invalid(f"unknown format {form}")
        e = self.resolve(archive, path)
        found = self.documents.filter((F.col("archive") == e["archive"]) & (F.col("doc_id") == e["idx"])).select("title", "markdown", F.col(form).alias("body"), "sections").take(1)
        if not found:
            raise NoSuchEntry(f"{path} is no article")
        body, outline = found[0].body, [s.asDict() for s in found[0].sections]
        if section is not None:
            k = find_section([s["title"] for s in outline], section)
            if k is None:
                raise NoSuchEntry(f"no section {section}")
            body = found[0].markdown[outline[k]["start"] : outline[k]["end"]]
            body = body if form == "markdown" else articles.plain_section(body)
        after = len(body) if max_chars is None else offset + max_chars
        cut = after < len(body)
        row = {"title": found[0].title, "content": body[offset:after], "total_chars": len(body), "next_offset": after if cut else None, "outline": outline if cut and section is None else None}
        return Page([row | {"archive": e["archive"], "path": e["path"], "redirected_from": path if e["redirected"] else None}])

    def outline(self, archive: str, path: str) -> Page:
        rows = self._document(archive, path).select(F.posexplode("sections").alias("index", "s")).select("index", "s.level", "s.title", (F.col("s.end") - F.col("s.start")).alias("chars"))
        return Page([r.asDict() for r in rows.orderBy("index").collect()])

    def links(self, archive: str, path: str, limit: int = 100, offset: int = 0) -> Page:
        """Internal links, each target once, with whether it exists; a target that is a redirect counts as what it leads to."""
        e = self.resolve(archive, path)
        rows = self._document(archive, path).select("doc_id", F.posexplode("links").alias("ord", "l")).select("doc_id", "ord", "l.*").filter("kind = 'internal'").withColumn("key", F.concat_ws("/", "ns", "path"))
        numbered = articles.first_per_target(rows, "doc_id", "key")
        top = offset + min(500, max(1, limit))
        once = numbered.filter((F.col("n") > offset) & (F.col("n") <= top + 1))
        own = self.entries.filter(F.col("archive") == e["archive"])
        page = [r.asDict() for r in articles.link_targets(once, own).orderBy("n").collect()]  # a page of 501 at most
        more = len(page) > top - offset
        return Page(page[: top - offset], None, None, {"next_offset": top if more else None})

    def context(self, query: str, archives: list[str] = (), budget_chars: int = 12000, per_hit_chars: int = 1500, max_hits: int = 6) -> Page:
        """The best excerpts of the best hits, as many as the budget holds, each with its source."""
        max_hits, per_hit = min(20, max(1, max_hits)), min(20000, max(100, per_hit_chars))
        budget = max(budget_chars, min(per_hit, 500))
        hits = self.search(query, archives, min(50, 2 * max_hits), snippet_chars=0).rows
        if not hits:
            return Page([])
        plain, _ = split_phrases(query)
        keys = self.spark.createDataFrame([(h["rank"], h["archive"], h["doc_id"]) for h in hits], "rank int, archive string, doc_id long")  # at most 40 rows
        docs = self.documents.select("archive", "doc_id", "language", "markdown", "sections").join(F.broadcast(keys), ["archive", "doc_id"])

        def excerpts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.itertuples():
                    find = snippets.term_finder(analyze.terms(plain, r.language), r.language)
                    out.append((1, r.rank, *best_excerpt(r.markdown, list(r.sections), find, per_hit)))
                yield pd.DataFrame(out, columns=["query", "rank", "text", "section"])

        found = docs.mapInPandas(excerpts, "query int, rank int, text string, section string").filter("text <> ''").cache()
        packed = articles.pack(found.select("query", "rank", "text"), budget, max_hits).join(found.select("rank", "section"), "rank").orderBy("rank").collect()
        found.unpersist()
        by_rank = {h["rank"]: h for h in hits}
        rows = []
        for r in packed:
            h = by_rank[r.rank]
            source = h["uri"] + (f"#{r.section.replace(' ', '_')}" if r.section else "")
            rows.append({"title": h["title"], "archive": h["archive"], "section": r.section, "text": r.text, "source": source})
        return Page(rows)

    def health(self, archive: str | None = None, verify: str = "none") -> Page:
        """What each archive has, coverage of its pages by documents, and the first problem of each check.

        verify: none looks at the tables only, quick checks orders, pointers and types in the files, full all clusters and the checksum too.
        """
        if verify not in ("none", "quick", "full"):
            raise Invalid(f"unknown level {verify}")
        if verify == "full" and not self.full_verify:
            raise Invalid("full verification reads whole archives and is switched off here")
        names = self.select([archive] if archive else [])
        columns = ["file", "uuid", "size", "entry_count", "html_count", "has_fulltext", "fulltext_docs", "has_title_index", "title_docs", "has_listing", "has_positions", "has_termlist", "indexed_docs"]
        found: dict[str, list] = {}
        if verify == "none":
            e = self.entries.filter(F.col("archive").isin(names))
            for p in entries.first_problem({"order": entries.order_problems(e, ["ns", "path"]), "mime": e.filter("kind = 'item' and mime is null")}).collect():
                found.setdefault(p["archive"], []).append({"check": p["check"], "first_idx": p["first_idx"], "n": p["n"]})
        else:
            by_file = {self.rows[n].file: n for n in names}
            for p in integrity.report(integrity.problems(self.spark, sorted(by_file), integrity.QUICK if verify == "quick" else integrity.FULL)).collect():
                found.setdefault(by_file[p["file"]], []).append({"check": p["check"], "first_idx": p["place"], "n": p["n"], "message": p["message"]})
        rows = []
        for n in names:
            r = self.rows[n].asDict()
            html, docs = r["html_count"] or 0, r["indexed_docs"] or 0
            bad = sorted(found.get(n, []), key=lambda p: p["check"])
            checksum = "skipped" if verify != "full" else "mismatch" if any(p["check"] == "checksum" for p in bad) else "ok"
            rows.append({"name": n, **{c: r[c] for c in columns}, "coverage": round(min(1.0, docs / html), 3) if html else None, "checksum": checksum, "problems": bad})
        failures = [r.asDict() for r in self.opened.filter("error is not null").select("file", "error").orderBy("file").collect()]
        return Page(rows, len(rows), None, {"failures": failures})

    def list_resources(self) -> Page:
        """Every archive as a resource, and the templates of what else can be read."""
        rows = [{"uri": f"zim://{n}", "name": r.title or n, "mime": "application/json"} for n, r in self.rows.items()]
        return Page(rows, len(rows), None, {"templates": ["zim://{archive}", "zim://{archive}/{path}", "zim://{archive}/{path}?format={markdown|text}"]})

    def read_resource(self, uri: str) -> str:
        """`zim://archive`: its row as JSON; `zim://archive/path[?format=text]`: the whole article."""
        m = re.fullmatch(r"zim://([^/?]+)(?:/([^?]*))?(?:\?format=(\w+))?", uri)
        if not m:
            raise Invalid(uri)
        if not m[2]:
            return json.dumps(self.rows[self.select([m[1]])[0]].asDict(recursive=True), default=str)
        return self.read_article(m[1], m[2], m[3] or "markdown", max_chars=None).rows[0]["content"]


def find_section(titles: list[str], name: str) -> int | None:
    """By number, else the first title that equals, begins with or contains the name, whatever the case."""
    if name.isdigit():
        return int(name) if int(name) < len(titles) else None
    want = name.lower()
    for fits in (str.__eq__, str.startswith, str.__contains__):
        for k, t in enumerate(titles):
            if fits(t.lower(), want):
                return k
    return None


# Renderings ---------------------------------------------------------------------------------------------------------------


def render_search(page: Page) -> str:
    lines = [f"{len(page.rows)} of {page.total} results"]
    for h in page.rows:
        lines += [f"{h['rank']}. {h['title']} ({h['archive']}, {h['score']:.2f}{', some words' if h['partial'] else ''})", f"   {h['uri']}"]
        lines += [f"   {h['snippet']}"] if h["snippet"] else []
    lines += [f"note: {w}" for w in page.more.get("warnings", [])]
    return "\n".join(lines + ([f"next: {page.cursor}"] if page.cursor else []))


def render_article(page: Page) -> str:
    """An article's window, with where it is from and how to go on."""
    r = page.rows[0]
    head = [f"# {r['title']} ({r['archive']})"] + ([f"redirected from {r['redirected_from']}"] if r["redirected_from"] else [])
    tail = [f"[{len(r['content'])} of {r['total_chars']} characters; next offset {r['next_offset']}]"] if r["next_offset"] is not None else []
    outline = [render_outline(Page([{"index": k, "level": s["level"], "title": s["title"], "chars": s["end"] - s["start"]} for k, s in enumerate(r["outline"])]))] if r["outline"] else []
    return "\n\n".join(head + [r["content"].strip()] + tail + outline)


def render_archives(page: Page) -> str:
    return "\n".join(f"{r['name']}: {r['title'] or r['archive']} [{r['language'] or '?'}], {r['entry_count']} entries" for r in page.rows)


def render_context(page: Page) -> str:
    """Excerpts as Markdown, each with its source."""
    part = lambda r: f"## {r['title']} ({r['archive']}){' — ' + r['section'] if r['section'] else ''}\n\n{r['text']}\n\nSource: {r['source']}"
    return "\n\n---\n\n".join(map(part, page.rows))


def render_outline(page: Page) -> str:
    return "\n".join(f"{'  ' * (r['level'] - 1)}{r['index']}. {r['title']} ({r['chars']})" for r in page.rows)


def render_suggest(page: Page) -> str:
    return "\n".join(f"{r['title']} ({r['archive']})" for r in page.rows)


def render_links(page: Page) -> str:
    return "\n".join(f"{r['n']}. {r['text']} -> {r['ns']}/{r['path']}{'' if r['exists'] else ' (missing)'}" for r in page.rows)


def render_health(page: Page) -> str:
    lines = []
    for r in page.rows:
        lines.append(f"{r['name']}: {r['entry_count']} entries, {r['indexed_docs'] or 0} indexed, coverage {r['coverage']}, checksum {r['checksum']}, {len(r['problems'])} problems")
        lines += [f"  {p['check']}: {p.get('message') or 'entry %s' % p['first_idx']} ({p['n']})" for p in r["problems"]]
    return "\n".join(lines + [f"failed: {f['file']}: {f['error']}" for f in page.more.get("failures", [])])
