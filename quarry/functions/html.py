"""Pages as documents: a small HTML tree, selectors, Markdown and plain renderings, links, sections, records and subtitles.

A render makes a list of blocks; inline markup inside a block is one string whose white space is collapsed at the end. A heading
is a block that knows its level, so section offsets are counted while blocks are joined and never searched for.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quarry.functions import adapters

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template head title svg iframe object button select textarea input audio video canvas dialog menu".split())
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HEADING = {f"h{k}": k for k in range(1, 7)}
WRAP = {"strong": "**", "b": "**", "em": "*", "i": "*", "cite": "*", "dfn": "*", "var": "*", "s": "~~", "del": "~~", "strike": "~~", "code": "`", "kbd": "`", "samp": "`", "tt": "`"}
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})} | {
    t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")
}
_BREAK = "\0"


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Node | None = None

    def walk(self):
        """The element and all elements below, in document order."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def plain(self) -> str:
        parts, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                parts.append(n)
            elif n.tag not in SKIPPED:
                todo += reversed(n.children)
        return " ".join("".join(parts).split())

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    """Elements by nesting; missing end tags are implied, stray ones are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close_to(self, tags: set, stop: set) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return self._close_to(tags, stop)
            if self.open[k].tag in stop:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            self._close_to(*_CLOSES[tag])
        elif tag in BLOCK:
            self._close_to({"p"}, {"table", "td", "th", "li", "dd", "blockquote", "div", "button"})
        if tag == "body":
            self._close_to({"head"}, set())
        parent = self.open[-1]
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, [], parent)
        parent.children.append(node)
        if tag not in VOID and len(self.open) < 400:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1].tag == tag and tag in ("svg", "path", "mi", "mo", "mn", "mrow"):  # self-closing counts in foreign content only
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


# Selectors ----------------------------------------------------------------------------------------------------------------

_PART = re.compile(r"([#.]?)([\w-]+)|\[([\w-]+)=\"?([^\]\"]*)\"?\]")


def _is(node: Node, compound: str) -> bool:
    for kind, name, attr, value in _PART.findall(compound):
        ok = node.attrs.get(attr) == value if attr else node.attrs.get("id") == name if kind == "#" else name in node.classes if kind == "." else node.tag == name
        if not ok:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """Whether a node is meant by `tag#id.class[attr=value]`, possibly below ancestors named before it."""
    *above, last = selector.split()
    if not _is(node, last):
        return False
    for compound in reversed(above):
        node = node.parent
        while node is not None and not _is(node, compound):
            node = node.parent
        if node is None:
            return False
    return True


def prune(root: Node, selectors: list[str]) -> None:
    for n in root.walk():
        n.children = [c for c in n.children if isinstance(c, str) or not any(matches(c, s) for s in selectors)]


def content_root(root: Node, selectors: list[str]) -> Node:
    """The first element of the first selector that has any, else the body, else all."""
    nodes = list(root.walk())
    for s in [*selectors, "body"]:
        for n in nodes:
            if matches(n, s):
                return n
    return root


# Links --------------------------------------------------------------------------------------------------------------------

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


@dataclass(frozen=True)
class Target:
    kind: str  # internal, external or anchor
    ns: str | None = None
    path: str | None = None
    fragment: str | None = None
    url: str | None = None


def resolve_href(ns: str, path: str, href: str) -> Target | None:
    """What a link of entry ns/path points to; None for empty, script and data links. A climb out of the namespace may name another."""
    href = href.strip()
    if not href or re.match(r"(?i)(javascript|data):", href):
        return None
    if href[0] == "#":
        return Target("anchor", fragment=unquote(href[1:]))
    if href.startswith("//"):
        return Target("external", url="https:" + href)
    if _SCHEME.match(href):
        return Target("external", url=href)
    rest, mark, fragment = href.partition("#")
    rest = unquote(rest.partition("?")[0])
    at = [ns] if rest.startswith("/") else [ns, *path.split("/")[:-1]]
    for step in rest.split("/"):
        if step == "..":
            at[-1:] = []
        elif step not in ("", "."):
            at.append(step)
    at = [s for s in at if s]
    if at and len(at[0].encode()) == 1:
        ns, at = at[0], at[1:]
    return Target("internal", ns, "/".join(at), unquote(fragment) if mark else None) if at else None


def user_path(ns: str, path: str, new_scheme: bool) -> str:
    return path if new_scheme and ns == "C" else f"{ns}/{path}"


# Rendering ----------------------------------------------------------------------------------------------------------------


class Heading(str):
    """A block that begins a section."""

    level: int
    title: str


@dataclass
class Place:
    """Where a page lies, and how its links are written."""

    ns: str = "C"
    path: str = ""
    new_scheme: bool = True
    prefix: str | None = None


class Render:
    """One pass over a tree, to Markdown or to plain text."""

    def __init__(self, place: Place, markdown: bool):
        self.place, self.markdown, self.links = place, markdown, []

    def _mark(self, mark: str, inner: str) -> str:
        """inner with marks around its words; white space stays outside."""
        words = inner.strip()
        if not words or not self.markdown:
            return inner
        lead = inner[: len(inner) - len(inner.lstrip())]
        return f"{lead}{mark}{words}{mark}{inner[len(inner.rstrip()) :]}"

    @staticmethod
    def _tidy(raw: str) -> str:
        lines = re.sub(r"[ \t\r\n\f]+", " ", raw).split(_BREAK)
        return "\n".join(x.strip() for x in lines).strip()

    @staticmethod
    def _has_block(n: Node) -> bool:
        return any(d.tag in BLOCK for d in n.walk() if d is not n)

    def _target(self, n: Node) -> Target | None:
        return resolve_href(self.place.ns, self.place.path, n.attrs.get("href") or "")

    def _link(self, n: Node, inner: str) -> str:
        to = self._target(n)
        if to is None or not inner.strip():
            return inner if to is None else ""
        self.links.append((n.plain(), to))
        if not self.markdown:
            return inner
        if to.kind == "internal":
            fragment = f"#{to.fragment}" if to.fragment else ""
            url = (self.place.prefix or "") + user_path(to.ns, to.path, self.place.new_scheme) + fragment
        else:
            url = f"#{to.fragment}" if to.kind == "anchor" else to.url
        return f"[{inner.strip()}]({url.replace(' ', '%20')})"

    def inline(self, nodes: list) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(n.replace(_BREAK, ""))
            elif n.tag in SKIPPED or "hidden" in n.attrs:
                continue
            elif n.tag == "br":
                out.append(_BREAK)
            elif n.tag == "img":
                alt = " ".join((n.attrs.get("alt") or "").split())
                out.append((f"![{alt}]" if self.markdown else alt) if alt else "")
            elif n.tag == "math":
                formula = n.attrs.get("alttext") or n.plain()
                out.append(f"${formula}$" if self.markdown else formula)
            elif n.tag == "a":
                out.append(self._link(n, self.inline(n.children)))
            elif n.tag in WRAP:
                out.append(self._mark(WRAP[n.tag], self.inline(n.children)))
            else:
                pad = " " if n.tag in BLOCK else ""
                out.append(pad + self.inline(n.children) + pad)
        return "".join(out)

    def flow(self, nodes: list) -> list[str]:
        """The blocks of mixed content: runs of inline nodes are paragraphs."""
        out, run = [], []

        def flush():
            if run and (text := self._tidy(self.inline(run))):
                out.append(text)
            run.clear()

        for n in nodes:
            if isinstance(n, str):
                run.append(n)
            elif n.tag in SKIPPED or "hidden" in n.attrs:
                continue
            elif n.tag in BLOCK or self._has_block(n):
                flush()
                if n.tag == "a" and (to := self._target(n)) is not None and n.plain():
                    self.links.append((n.plain(), to))
                out += self.block(n)
            else:
                run.append(n)
        flush()
        return out

    def block(self, n: Node) -> list[str]:
        if n.tag in HEADING:
            return self._heading(n)
        if n.tag == "hr":
            return ["---"] if self.markdown else []
        if n.tag == "pre":
            return self._pre(n)
        if n.tag in ("ul", "ol"):
            return self._list(n)
        if n.tag == "dl":
            return self._definitions(n)
        if n.tag == "table":
            return self._table(n)
        blocks = self.flow(n.children)
        if n.tag == "blockquote" and self.markdown:
            return ["\n".join("> " + line for line in b.split("\n")) for b in blocks]
        mark = {"summary": "**", "figcaption": "*", "caption": "*"}.get(n.tag)
        if mark and not self._has_block(n):
            return [self._mark(mark, b) for b in blocks]
        return blocks

    def _heading(self, n: Node) -> list[str]:
        title = self._tidy(self.inline(n.children)).replace("\n", " ")
        if not title:
            return []
        level = HEADING[n.tag]
        h = Heading(f"{'#' * level} {title}" if self.markdown else title)
        h.level, h.title = level, n.plain()
        return [h]

    def _pre(self, n: Node) -> list[str]:
        parts = []
        for d in self._leaves(n):
            parts.append(d)
        code = "".join(parts).strip("\n")
        if not code.strip():
            return []
        names = [c for x in n.walk() if x.tag in ("pre", "code") for c in x.classes if c.startswith("language-")]
        return [f"```{names[0][9:] if names else ''}\n{code}\n```" if self.markdown else code]

    @staticmethod
    def _leaves(n: Node):
        for c in n.children:
            if isinstance(c, str):
                yield c
            elif c.tag == "br":
                yield "\n"
            else:
                yield from Render._leaves(c)

    def _list(self, n: Node) -> list[str]:
        start = n.attrs.get("start") or "1"
        number = int(start) if re.fullmatch(r"-?\d+", start) else 1
        items = []
        for li in n.children:
            if isinstance(li, str) or li.tag != "li" or "hidden" in li.attrs:
                continue
            body = "\n".join(self.flow(li.children))
            if not body:
                continue
            marker = f"{number}. " if n.tag == "ol" else "- "
            items.append(marker + body.replace("\n", "\n  "))
            number += 1
        return ["\n".join(items)] if items else []

    def _definitions(self, n: Node) -> list[str]:
        lines = []
        for d in n.walk():
            if d.tag == "dt":
                lines += [self._mark("**", b) for b in self.flow(d.children)]
            elif d.tag == "dd":
                lines += ["  " + b.replace("\n", "\n  ") for b in self.flow(d.children)]
        return ["\n".join(lines)] if lines else []

    def _rows(self, n: Node) -> list[list[Node]]:
        rows, todo = [], [n]
        while todo:
            x = todo.pop(0)
            if x.tag == "tr":
                rows.append([c for c in x.children if isinstance(c, Node) and c.tag in ("td", "th")])
            elif x is n or x.tag != "table":
                todo = [c for c in x.children if isinstance(c, Node)] + todo
        return [r for r in rows if r]

    def _cell(self, c: Node) -> str:
        return " ".join(" ".join(self.flow(c.children)).split()).replace("|", "\\|")

    def _table(self, n: Node) -> list[str]:
        out = [self._mark("*", b) for c in n.children if isinstance(c, Node) and c.tag == "caption" for b in self.flow(c.children)]
        rows = self._rows(n)
        if any("infobox" in c for c in n.classes):
            lines = []
            for r in rows:
                label, *rest = [self._cell(c) for c in r]
                value = " ".join(x for x in rest if x)
                if label and value:
                    lines.append(f"- {self._mark('**', label + ':')} {value}")
                elif label or value:
                    lines.append(f"- {label or value}")
            return [*out, "\n".join(lines)] if lines else out
        cells = [[self._cell(c) for c in r] for r in rows]
        cells = [r for r in cells if any(r)]
        if not cells:
            return out
        if not self.markdown:
            return [*out, "\n".join(" | ".join(r) for r in cells)]
        width = max(map(len, cells))
        lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in cells]
        return [*out, "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])]


def join_blocks(blocks: list[str]) -> tuple[str, list[dict]]:
    """The text of blocks and its sections; each ends where one of its level or higher begins. Offsets are code points."""
    at, heads = 0, []
    for b in blocks:
        if isinstance(b, Heading):
            heads.append((b.level, b.title, at))
        at += len(b) + 2
    text = "\n\n".join(blocks) + "\n" if blocks else ""
    sections = []
    for k, (level, title, start) in enumerate(heads):
        end = next((s for lv, _, s in heads[k + 1 :] if lv <= level), len(text))
        sections.append({"level": level, "title": title, "start": start, "end": end})
    return text, sections


def _loosen(nodes: list[Node]) -> None:
    """Lets a tree go at once: a node and its parent name each other, and such trees pile up until the collector finds them."""
    for n in nodes:
        n.parent = None


def _blocks(render: Render, root: Node) -> list[str]:
    return render.block(root) if root.tag in BLOCK and root.tag not in HEADING else render.flow(root.children)


def _named(found: list[tuple[str, Target]]) -> list[dict]:
    return [{"text": t, "kind": to.kind, "ns": to.ns, "path": to.path, "fragment": to.fragment, "url": to.url} for t, to in found]


def links_of(html: str, adapter: str = "generic", place: Place | None = None) -> list[dict]:
    """The links of extract() alone."""
    tree, md = parse(html), Render(place or Place(), True)
    nodes = list(tree.walk())
    prune(tree, adapters.PRUNE[adapter])
    _blocks(md, content_root(tree, adapters.CONTENT[adapter]))
    out = _named(md.links)
    _loosen(nodes)
    return out


def extract(html: str, adapter: str = "generic", hint: str | None = None, place: Place | None = None) -> dict:
    """title, markdown, text, sections, links (text, kind, ns, path, fragment, url) and word_count of a page."""
    tree, place = parse(html), place or Place()
    nodes = list(tree.walk())
    title = next((" ".join("".join(c for c in n.children if isinstance(c, str)).split()) for n in nodes if n.tag == "title"), "")
    prune(tree, adapters.PRUNE[adapter])
    root = content_root(tree, adapters.CONTENT[adapter])
    md, plain = Render(place, True), Render(place, False)
    markdown, sections = join_blocks(_blocks(md, root))
    text, _ = join_blocks(plain.block(root) if root.tag in BLOCK else plain.flow(root.children))
    title = title or next((n.plain() for n in tree.walk() if n.tag in HEADING and n.plain()), "") or hint or ""
    _loosen(nodes)
    return {"title": title, "markdown": markdown, "text": text, "sections": sections, "links": _named(md.links), "word_count": len(text.split())}


# Records ------------------------------------------------------------------------------------------------------------------


def transcript(vtt: str) -> str:
    """The spoken lines of WebVTT subtitles: no headers, times or tags, and no line twice in a row."""
    lines = []
    for cue in re.split(r"\n\s*\n", vtt.replace("\r", "")):
        rows = cue.split("\n")
        times = next((k for k, r in enumerate(rows) if "-->" in r), len(rows))
        for row in rows[times + 1 :]:
            row = re.sub(r"<[^>]*>?", "", row)
            for code, c in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
                row = row.replace(code, c)
            row = row.strip()
            if row and "-->" not in row and (not lines or lines[-1] != row):
                lines.append(row)
    return "\n".join(lines)


def subtitle_path(record: dict) -> str | None:
    """Where the first subtitles of a video record lie, English before others."""
    codes = sorted((s["code"] for s in record.get("subtitleList") or [] if s.get("code")), key=lambda c: (not c.startswith("en"), c))
    return f"videos/{record.get('id', '')}/video.{codes[0]}.vtt" if codes else None


def video_document(raw: str, hint: str = "", vtt: str | None = None) -> dict:
    """The document of a video record: channel, date, length, description, chapters, transcript."""
    r = json.loads(raw)
    title = r.get("title") or hint
    facts = [("Channel", (r.get("author") or {}).get("channelTitle")), ("Published", r.get("publicationDate")), ("Duration", r.get("duration"))]
    blocks = [f"# {title}", "  \n".join(f"**{k}:** {v}" for k, v in facts if v)]
    if (r.get("description") or "").strip():
        blocks += ["## Description", r["description"].strip()]
    chapters = r.get("chapterList") or []
    if len(chapters) > 1:
        times = [divmod(int(c.get("startTime") or 0), 60) for c in chapters]
        blocks += ["## Chapters", "\n".join(f"- {m:02}:{s:02} {c.get('title') or ''}" for c, (m, s) in zip(chapters, times, strict=True))]
    spoken = transcript(vtt) if vtt else ""
    if spoken:
        code = (subtitle_path(r) or "").rsplit(".", 2)[-2:-1] or [""]
        blocks += [f"## Transcript ({code[0]})", spoken]
    markdown = "\n\n".join(b for b in blocks if b) + "\n"
    heads = [(m.start(), m[1]) for m in re.finditer(r"(?m)^## (.*)$", markdown)]
    ends = [at for at, _ in heads[1:]] + [len(markdown)]
    text = re.sub(r"\*\*|(?m:^#+ )", "", markdown)
    return {"title": title, "markdown": markdown, "text": text, "sections": [{"level": 2, "title": t.strip(), "start": a, "end": e} for (a, t), e in zip(heads, ends, strict=True)], "links": [], "word_count": len(text.split())}


def any_document(content: str, mime: str, adapter: str, hint: str = "", place: Place | None = None, vtt: str | None = None) -> dict | None:
    """By MIME type: pages, plain text and Markdown as they are, JSON records by adapter (with their subtitles); None for anything else."""
    if mime.startswith(("text/html", "application/xhtml")):
        return extract(content, adapter, hint, place)
    if mime.startswith(("text/plain", "text/markdown")):
        return {"title": hint, "markdown": content, "text": content, "sections": [], "links": [], "word_count": len(content.split())}
    if mime.startswith("application/json") and adapter == "youtube":
        return video_document(content, hint, vtt)
    if mime.startswith("application/json") and adapter == "libretexts":
        return extract(json.loads(content).get("htmlBody") or "", adapter, hint, place)
    return None


_SECTION = StructType([StructField("level", IntegerType()), StructField("title", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
_LINK = StructType([StructField(n, StringType()) for n in ("text", "kind", "ns", "path", "fragment", "url")])
DOCUMENT = StructType([StructField("title", StringType()), StructField("markdown", StringType()), StructField("text", StringType()), StructField("sections", ArrayType(_SECTION)), StructField("links", ArrayType(_LINK)), StructField("word_count", IntegerType())])
_ARROW = pa.struct(
    [("title", pa.string()), ("markdown", pa.string()), ("text", pa.string()), ("sections", pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
     ("links", pa.list_(pa.struct([(n, pa.string()) for n in ("text", "kind", "ns", "path", "fragment", "url")]))), ("word_count", pa.int32())]
)


#: So many rows are Python objects at once.
SLICE = 64


def _sliced(kernel, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """kernel() of each row. Only a slice of a batch is held as Python objects, which take several times the space of its columns."""
    parts = []
    for at in range(0, len(columns[0]), SLICE):
        rows = zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)
        parts.append(pa.array([kernel(*r) for r in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@arrow_udf(DOCUMENT)
def _document(content: pa.Array, mime: pa.Array, adapter: pa.Array, ns: pa.Array, path: pa.Array, prefix: pa.Array, hint: pa.Array, vtt: pa.Array) -> pa.Array:
    def kernel(c, m, a, n, p, x, h, v):
        return None if c is None else any_document(c, m or "", a or "generic", h or p or "", Place(n or "C", p or "", (n or "C") == "C", x), v)

    return _sliced(kernel, _ARROW, content, mime, adapter, ns, path, prefix, hint, vtt)


def document(content: Column, mime: Column, adapter: Column, ns: Column, path: Column, prefix: Column, hint: Column | None = None, vtt: Column | None = None) -> Column:
    """The document of each entry as a struct; null where its type has none. Put it after limits: it parses every row it sees.

    hint: a title where the content has none (else the path); vtt: the subtitles of a video record.
    """
    none = F.lit(None).cast("string")
    return _document(content, mime, adapter, ns, path, prefix, none if hint is None else hint, none if vtt is None else vtt)


@arrow_udf(ArrayType(_LINK))
def _links(content: pa.Array, adapter: pa.Array, ns: pa.Array, path: pa.Array) -> pa.Array:
    def kernel(c, a, n, p):
        return None if c is None else links_of(c, a or "generic", Place(n or "C", p or "", (n or "C") == "C"))

    return _sliced(kernel, _ARROW.field("links").type, content, adapter, ns, path)


def links(content: Column, adapter: Column, ns: Column, path: Column) -> Column:
    """The links of each page, as in its document(), without the document."""
    return _links(content, adapter, ns, path)


@arrow_udf(StringType())
def _subtitles(records: pa.Array) -> pa.Array:
    out = []
    for raw in records.to_pylist():
        try:
            out.append(subtitle_path(json.loads(raw)) if raw else None)
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


@arrow_udf(StringType())
def _spoken(vtt: pa.Array) -> pa.Array:
    return pa.array([None if v is None else transcript(v) for v in vtt.to_pylist()], pa.string())


def spoken(vtt: Column) -> Column:
    """The spoken lines of WebVTT subtitles."""
    return _spoken(vtt)


def subtitles_of(record: Column) -> Column:
    """Where the subtitles of each video record lie; null for none, and for what is no record."""
    return _subtitles(record)


def capped(content: Column, most: int = 4 << 20) -> Column:
    """The first `most` bytes of a binary column as text, whole characters only (a cut one would end as a replacement character)."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(content, 1, most).cast("string")), "\ufffd+$", "")
