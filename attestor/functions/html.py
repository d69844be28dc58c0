"""Pages in HTML: main text, title, DOI and publication date."""

from __future__ import annotations

import json
import re

import pandas as pd
from attestor.functions.arrow import arrow_udf
from attestor.functions.page_tree import FURNITURE, Node, build_html, render

# Meta names, best first.
TITLE_META = "citation_title og:title dc.title twitter:title".split()
DOI_META = "citation_doi dc.identifier prism.doi".split()
DATE_META = """
citation_publication_date citation_date article:published_time datepublished dc.date.issued dc.date og:published_time date pubdate parsely-pub-date
""".split()
NOISE = re.compile(r"(?i)(?:^|[\s_-])(nav|menu|share|social|related|promo|advert|ads?|cookie|banner|sidebar|footer|comments?|breadcrumbs?|newsletter|skip)(?:$|[\s_-])")
ENOUGH = 500


def _walk(node: Node):
    yield node
    for c in node.children:
        if isinstance(c, Node):
            yield from _walk(c)


def _score(node: Node) -> float:
    text = re.sub(r"\s+", " ", node.text())
    linked = sum(len(re.sub(r"\s+", " ", a.text())) for a in _walk(node) if a.tag == "a")
    return (len(text) - 3 * linked) + 25 * text.count(",")


def parse_page(markup: str) -> dict:
    """``text, title, doi, published``: furniture and hidden nodes pruned, then the
    longest article of ENOUGH characters, else main, else the best block, else the body."""
    root = build_html(markup)
    nodes = list(_walk(root))
    meta: dict[str, str] = {}
    for n in nodes:
        if n.tag == "meta":
            name = (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop") or "").lower()
            meta.setdefault(name, n.attrs.get("content", "").strip())
    first = lambda names: next((meta[x] for x in names if meta.get(x)), None)
    title = first(TITLE_META) or next((re.sub(r"\s+", " ", n.text()).strip() for n in nodes if n.tag == "title"), None)
    doi = re.search(r"(?i)10\.\d{4,9}/[^\s\"<>]+", first(DOI_META) or "")
    published = first(DATE_META)
    for n in nodes:
        if not published and n.tag == "script" and "ld+json" in n.attrs.get("type", ""):
            published = _json_date(n.text())
    if not published:
        published = next((n.attrs["datetime"] for n in nodes if n.tag == "time" and n.attrs.get("datetime")), None)
    for n in nodes:
        label = n.attrs.get("class", "") + " " + n.attrs.get("id", "") + " " + n.attrs.get("role", "")
        if n.tag in FURNITURE or n.tag not in ("html", "body", "article", "main") and NOISE.search(label):
            n.visible = False
    text = lambda n: len(render(n))
    articles = [n for n in nodes if n.tag == "article" and n.visible and text(n) >= ENOUGH]
    best = max(articles, key=text, default=None) or next((n for n in nodes if n.tag == "main" and n.visible and text(n)), None)
    if best is None:
        blocks = [n for n in nodes if n.tag in ("div", "section", "td") and n.visible and text(n) >= ENOUGH // 2]
        best = max(blocks, key=_score, default=None) or next((n for n in nodes if n.tag == "body"), root)
    return {"text": render(best), "title": title, "doi": doi[0].lower() if doi else None, "published": published}


def _json_date(raw: str) -> str | None:
    try:
        todo = [json.loads(raw)]
    except ValueError:
        return None
    while todo:
        x = todo.pop(0)
        if isinstance(x, dict):
            if isinstance(x.get("datePublished"), str):
                return x["datePublished"]
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return None


@arrow_udf("struct<text:string,title:string,doi:string,published:string>")
def page(markup: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("text", "title", "doi", "published"))
    return pd.DataFrame([parse_page(m) if isinstance(m, str) else empty for m in markup], columns=list(empty))
