"""How the pages of each kind of archive are laid out: where their content is and what of it goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Element names, ids and classes that the archives' makers use.
_WIDE = [
    "main",
    "article",
    "[role=main]",
    "#main-content",
    "#main",
    "#content",
    ".content",
    "#page",
    "body",
]
CONTENT = {
    "mwoffliner": [
        "#mw-content-text .mw-parser-output",
        ".mw-parser-output",
        "#mw-content-text",
        "#bodyContent",
        "#content",
    ],
    "devdocs": [
        "._page",
        "._content",
        "main",
    ],
    "gutenberg": [
        "body",
    ],
    "libretexts": [
        "body",
    ],
    "youtube": [
        "body",
    ],
    "zimit": _WIDE,
    "generic": _WIDE,
}
_CLUTTER = [
    "nav",
    "header",
    "footer",
    "aside",
    "#menu",
    ".menu",
    "#menu-fixed",
    ".burger",
    ".crumbs",
    ".breadcrumb",
    ".breadcrumbs",
    ".cookie",
    ".cookie-banner",
    ".sidebar",
    "#sidebar",
    ".share",
    ".social",
    ".comments",
    "#comments",
    "form",
    ".advertisement",
    ".ad",
    "#ta",
    ".skip-link",
    "[aria-hidden=true]",
]
PRUNE = {
    "mwoffliner": [
        ".navbox",
        ".vertical-navbox",
        ".navbox-styles",
        ".reflist",
        ".references",
        "ol.references",
        ".mw-references-wrap",
        ".mw-references",
        "sup.reference",
        "sup.mw-ref",
        ".mw-ref",
        ".mw-reflink-text",
        ".mw-cite-backlink",
        ".mw-editsection",
        ".hatnote",
        ".mw-empty-elt",
        ".noprint",
        ".metadata",
        ".ambox",
        ".mbox-small",
        ".sistersitebox",
        ".portalbox",
        ".portal-bar",
        "#toc",
        ".toc",
        ".mw-jump-link",
        ".zim-footer",
        "#mw-navigation",
        ".catlinks",
        ".printfooter",
        ".navigation-not-searchable",
        ".mw-authority-control",
        ".shortdescription",
        ".side-box",
        "#siteSub",
        "#contentSub",
        ".mw-indicators",
        ".vector-toc",
        ".error",
        "#References",
        "#External_links",
        ".external-links",
        ".navbox-inner",
    ],
    "devdocs": [
        "devdocs-navbar",
        "._attribution",
        "nav",
        ".icon",
    ],
    "gutenberg": [
        "#pg-header",
        "#pg-footer",
        ".pg-boilerplate",
        "#pg-machine-header",
        "#pg-start-separator",
        "#pg-end-separator",
        ".zim_info",
        ".zim_epub",
        ".zim_up",
        ".pagenum",
        ".tocpg",
    ],
    "libretexts": [
        ".mt-icon-article",
        "nav",
        ".sr-only",
    ],
    "youtube": [],
    "zimit": _CLUTTER,
    "generic": _CLUTTER,
}
#: (where to look, what to find there, layout), the first that fits.
RULES = [
    ("scraper", "mwoffliner", "mwoffliner"),
    ("scraper", "devdocs", "devdocs"),
    ("scraper", "warc2zim", "zimit"),
    ("scraper", "zimit", "zimit"),
    ("scraper", "gutenberg", "gutenberg"),
    ("name begins", "gutenberg", "gutenberg"),
    ("scraper", "mindtouch", "libretexts"),
    ("name", "libretexts", "libretexts"),
    ("scraper", "youtube", "youtube"),
    ("name begins", "wiki", "mwoffliner"),
]


def layout_of(scraper: str | None, name: str | None) -> str:
    """The layout of one archive by its scraper, then by its name."""
    s, n = (scraper or "").lower(), (name or "").lower()
    fits = {"scraper": lambda x: x in s, "name": lambda x: x in n, "name begins": n.startswith}
    return next((layout for where, x, layout in RULES if fits[where](x)), "generic")


def adapter_of(scraper: Column, name: Column) -> Column:
    """layout_of() as a column."""
    s, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (scraper, name))
    fits = {"scraper": s.contains, "name": n.contains, "name begins": n.startswith}
    out = F.when(F.lit(False), "")
    for where, x, layout in RULES:
        out = out.when(fits[where](x), layout)
    return out.otherwise("generic")
