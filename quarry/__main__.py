"""Command line: python -m quarry COMMAND ...; single archives are read as files, searches go over a library's tables."""

from __future__ import annotations

import argparse
import os
import re
import sys
import time

from quarry import integrity
from quarry.functions import adapters
from quarry.sources import zim

MODES = ["auto", "fulltext", "title", "listing"]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: tuple) -> None:
        c = sub.add_parser(name)
        for flag, options in args:
            c.add_argument(flag, **options)

    n = lambda k: {"type": int, "default": k}
    many, flag = {"action": "append", "default": []}, {"action": "store_true"}
    timed = ("--time", flag)
    command("info", ("file", {}))
    command("ls", ("file", {}), ("--ns", {}), ("--prefix", {"default": ""}), ("--title", flag), ("--limit", n(50)))
    command("cat", ("file", {}), ("path", {}), ("--no-follow", flag))
    command("check", ("file", {}), ("--checksum", flag), ("--clusters", flag))
    command("extract", ("file", {}), ("path", {}), ("--text", flag), ("--outline", flag), ("--section", {}), ("--link-prefix", {}))
    command("dump-index", ("file", {}), ("--kind", {"choices": ["fulltext", "title"], "default": "fulltext"}), ("-o", {"dest": "out", "required": True}))
    command("build", ("folder", {}), ("--zim-dir", many), ("--zim", many), ("--no-recursive", flag))
    # Below, `folder` is a library made by build, or archives (a file or a folder of them), of which one is made for the call.
    command("archives", ("folder", {"nargs": "?"}), ("--zim-dir", many), ("--zim", many), ("--no-recursive", flag), ("--filter", {}), ("--json", flag))
    search = [("-n", n(10)), ("--offset", n(0)), ("--any", flag), ("--mode", {"choices": MODES, "default": "auto"}), ("--archive", many), ("--cursor", {}), ("--snippet-chars", n(300)), ("--min-score", {"type": float}), ("--and-only", flag), ("--json", flag), timed]
    command("search", ("folder", {}), ("query", {}), *search)
    command("suggest", ("folder", {}), ("prefix", {}), ("-n", n(10)), ("--archive", many), ("--json", flag), timed)
    command("context", ("folder", {}), ("query", {}), ("--budget", n(12000)), ("--per-hit", n(1500)), ("--max-hits", n(6)), ("--archive", many), ("--json", flag))
    command("article", ("folder", {}), ("archive", {}), ("path", {}), ("--section", {}), ("--max-chars", n(8000)), ("--offset", n(0)), ("--json", flag))
    command("links", ("folder", {}), ("archive", {}), ("path", {}), ("--json", flag))
    command("health", ("folder", {}), ("--archive", {"default": None}), ("--verify", {"choices": ["none", "quick", "full"], "default": "none"}), ("--json", flag))
    command("serve", ("folder", {}), ("--http", {"help": "HOST:PORT; standard streams without"}), ("--token", {}), ("--priority", {**many, "metavar": "GLOB=WEIGHT"}))
    return p


# One archive -------------------------------------------------------------------------------------------------------------


def find(a: zim.Archive, path: str, follow: bool = True) -> tuple:
    """The entry of `C/path`, else of path in the content namespaces: a few bisections."""
    wanted = [(path[0], path[2:])] if path[1:2] == "/" else []
    found = next((e for ns, p in [*wanted, *((ns, path) for ns in "CAIJ-")] if (e := a.find(ns, p)) is not None), None)
    if found is None:
        raise zim.ZimError(f"no entry {path}")
    return a.resolve(found) if follow else found


def metadata(a: zim.Archive) -> dict[str, str]:
    """The texts among an archive's M entries."""
    lo, hi = a.namespace_range("M")
    return {e[3]: a.content(a.resolve(e)).decode("utf-8", "replace") for e in a.entries(lo, hi) if (e[6] or "text/").startswith("text/")}


def info(a: zim.Archive, path: str) -> list[str]:
    h, meta = a.header, metadata(a)
    kinds = {k: "no" if a.index_entry(k) is None else "yes" if a.index_ranges(k) else "compressed" for k in ("fulltext", "title")}
    main = a.main_entry()
    out = [
        f"file: {path}", f"size: {human(a.source.size)} ({a.source.size} bytes)", f"version: {h.major}.{h.minor} ({'new' if h.new_scheme else 'old'} namespaces)", f"uuid: {h.uuid}",
        f"entries: {h.entry_count}", f"clusters: {h.cluster_count}", f"types: {len(a.mimes)}", f"namespaces: {' '.join(a.namespaces())}", f"titles in order: {len(a.title_order())}",
        f"fulltext index: {kinds['fulltext']}", f"title index: {kinds['title']}", f"main page: {main[3] if main else '-'}", f"checksum: {'none' if h.checksum_ptr is None else 'stored'}",
    ]
    out += [f"{k}: {v[:200]}" for k, v in sorted(meta.items()) if k != "Counter"]
    counter = [(k.rpartition("=")[0], int(k.rpartition("=")[2])) for k in re.split(r";(?=[^;=]*/)", meta.get("Counter", "")) if re.search(r"=\d+$", k)]
    return out + [f"  {n:>10}  {mime}" for mime, n in sorted(counter, key=lambda x: (-x[1], x[0]))[:6]]


def human(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TiB"


def problems(a: zim.Archive, checksum: bool, clusters: bool) -> list[str]:
    """The first problem of each check."""
    out = []
    for check in [*integrity.QUICK, *(["checksum"] if checksum else []), *(["clusters"] if clusters else [])]:
        found = integrity.check_range(a, check, 0, integrity._size(a, check))
        out += [f"{check}: {found[0][1]}"] if found else []
    return out


def layout(a: zim.Archive, name: str) -> str:
    """How an archive's pages are laid out, by its scraper or name."""
    meta = metadata(a)
    return adapters.layout_of(meta.get("Scraper"), meta.get("Name") or re.sub(r"(?i)\.zim(aa)?$", "", name))


def _one_archive(o: argparse.Namespace) -> int:
    a = zim.Archive(o.file)
    if o.command == "info":
        print("\n".join(info(a, o.file)))
    elif o.command == "ls":
        lo, hi = a.namespace_range(o.ns) if o.ns else (0, a.header.entry_count)
        order = a.title_order() if o.title else []
        rows = map(a.entry, order) if order else a.entries(lo, hi)
        shown = (e for e in rows if (not o.ns or e[2] == o.ns) and ((e[4] or e[3]) if o.title else e[3]).startswith(o.prefix))
        for k, e in enumerate(shown):
            if o.limit and k >= o.limit:
                break
            print(f"{e[2]}/{e[3]}\t{e[4] or e[3]}\t{e[6] or e[5]}")
    elif o.command == "cat":
        sys.stdout.buffer.write(a.content(find(a, o.path, not o.no_follow)))
    elif o.command == "check":
        found = problems(a, o.checksum, o.clusters)
        print("\n".join(found) or "no problem")
        return int(bool(found))
    elif o.command == "dump-index":
        e = a.index_entry(o.kind)
        if e is None:
            raise zim.ZimError(f"no {o.kind} index")
        with open(o.out, "wb") as f:
            f.write(a.content(a.resolve(e)))
    else:
        from quarry.functions import html
        from quarry.library import find_section

        e = find(a, o.path)
        d = html.any_document(a.content(e).decode("utf-8", "replace"), e[6] or "", layout(a, a.name), e[4] or e[3], html.Place(e[2], e[3], a.header.new_scheme, o.link_prefix))
        if d is None:
            raise zim.ZimError(f"{e[3]} is no document")
        if o.outline:
            print("\n".join(f"{'#' * s['level']} {s['title']}" for s in d["sections"]))
        elif o.section is not None:
            k = find_section([s["title"] for s in d["sections"]], o.section)
            if k is None:
                raise zim.ZimError(f"no section {o.section}")
            print(d["markdown"][d["sections"][k]["start"] : d["sections"][k]["end"]])
        else:
            print(d["text" if o.text else "markdown"])
    return 0


# A library ---------------------------------------------------------------------------------------------------------------


def _library(o: argparse.Namespace, spark) -> int:
    from quarry import library as L

    if o.command == "build":
        for f in L.build(spark, sorted({*o.zim, *zim.discover(o.zim_dir, not o.no_recursive)}), o.folder):
            print(f"{f['file']}: {f['error']}", file=sys.stderr)
        return 0
    lib = L.Library(spark, _tables(o, spark), [(g, float(w)) for g, _, w in (x.rpartition("=") for x in getattr(o, "priority", []))])
    if o.command == "serve":
        from quarry import serve

        if not o.http:
            serve.run_stdio(lib, sys.stdin, sys.stdout)
            return 0
        host, _, port = o.http.rpartition(":")
        serve.http_server(lib, host or "127.0.0.1", int(port), o.token).serve_forever()
        return 0
    begun = time.perf_counter()
    page, text = {
        "archives": lambda: (lib.list_archives(o.filter), L.render_archives),
        "search": lambda: (lib.search(o.query, o.archive, o.n, o.cursor, o.snippet_chars, o.min_score, not o.and_only, o.mode, o.offset, o.any), L.render_search),
        "suggest": lambda: (lib.suggest(o.prefix, o.archive, o.n), L.render_suggest),
        "context": lambda: (lib.context(o.query, o.archive, o.budget, o.per_hit, o.max_hits), L.render_context),
        "article": lambda: (lib.read_article(o.archive, o.path, "markdown", o.max_chars, o.offset, o.section), L.render_article),
        "links": lambda: (lib.links(o.archive, o.path), L.render_links),
        "health": lambda: (lib.health(o.archive, o.verify), L.render_health),
    }[o.command]()
    print(page.to_json() if o.json else text(page))
    if getattr(o, "time", False):
        print(f"{time.perf_counter() - begun:.3f} s", file=sys.stderr)
    return 0


def _tables(o: argparse.Namespace, spark) -> str:
    """The library's folder; archives that are not built yet are built for this call."""
    from quarry import library as L
    from quarry import storage

    if o.folder and os.path.isdir(os.path.join(o.folder, "archives")):
        return o.folder
    more = [o.folder] if o.folder else []
    files = [*getattr(o, "zim", []), *(f for f in more if os.path.isfile(f))]
    files += zim.discover([*getattr(o, "zim_dir", []), *(f for f in more if os.path.isdir(f))], not getattr(o, "no_recursive", False))
    if not files:
        raise L.EmptyLibrary(f"neither a library nor archives: {o.folder}")
    folder = storage.scratch(spark, "library")
    for f in L.build(spark, sorted(set(files)), folder):
        print(f"{f['file']}: {f['error']}", file=sys.stderr)
    return folder


def main(args: list[str], spark=None) -> int:
    o = _parser().parse_args(args)
    try:
        if hasattr(o, "file"):
            return _one_archive(o)
        from pyspark.sql import SparkSession

        return _library(o, spark or SparkSession.builder.appName("quarry").getOrCreate())
    except (zim.ZimError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
    except Exception as e:
        from quarry.library import LibraryError

        if not isinstance(e, LibraryError):
            raise
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
