"""A small page tree: built from HTML with implied tags, rendered to text.

The tree is what layout needs and no more: blocks, lists, tables, headings and
which nodes are visible.  It is a helper inside Arrow UDFs; Spark partitions
the pages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# HTML's own element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
HIDDEN = set("script style noscript template head svg iframe object canvas select button textarea title".split())
FURNITURE = set("nav aside footer form dialog menu".split())
# opening one of these ends an open element of those
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
} | {b: {"p"} for b in BLOCKS - {"li", "dt", "dd", "tr", "td", "th", "tbody", "tfoot", "html", "body"}}
SCOPES = {"ul", "ol", "table", "dl"}  # implied ends do not reach out of these


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list["Node | str"] = field(default_factory=list)
    visible: bool = True
    parent: "Node | None" = field(default=None, repr=False, compare=False)

    def text(self) -> str:
        return " ".join(c if isinstance(c, str) else c.text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.root.pieces = []  # (line from 1, text, the node that holds it)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = CLOSES.get(tag, set())
        cut = len(self.open)
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in SCOPES:
                break
            if self.open[i].tag in ends:
                cut = i  # the outermost one within the scope
        del self.open[cut:]
        parent = self.open[-1]
        if tag in ("td", "th") and parent.tag != "tr" or tag == "tr" and parent.tag not in ("table", "tbody", "thead", "tfoot"):
            implied = Node("tr" if tag != "tr" else "table", parent=parent)
            parent.children.append(implied)
            self.open.append(implied)
            parent = implied
        if tag == "li" and parent.tag not in ("ul", "ol", "menu"):
            implied = Node("ul", parent=parent)
            parent.children.append(implied)
            self.open.append(implied)
            parent = implied
        a = {k: v or "" for k, v in attrs}
        node = Node(tag, a, visible=self._visible(tag, a), parent=parent)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)

    @staticmethod
    def _visible(tag: str, a: dict[str, str]) -> bool:
        style = a.get("style", "").replace(" ", "").lower()
        return not (
            tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        )

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)
        self.root.pieces.append((self.getpos()[0], data, self.open[-1]))


def build_html(markup: str) -> Node:
    """The tree of a page; unclosed and missing tags are implied, never an error."""
    b = _Builder()
    b.feed(markup)
    b.close()
    return b.root


def hidden_lines(root: Node) -> list[int]:
    """Numbers from 0 of the markup's lines whose text is all out of sight: in hidden nodes or in furniture."""
    seen: dict[int, bool] = {}
    for line, data, node in root.pieces:
        n: Node | None = node
        while n is not None and n.visible and n.tag not in FURNITURE:
            n = n.parent
        for i, part in enumerate(data.split("\n")):
            if part.strip():
                at = line - 1 + i
                seen[at] = seen.get(at, False) or n is None
    return sorted(at for at, visible in seen.items() if not visible)


def render(node: Node) -> str:
    """Visible text: blocks apart by blank lines, list markers, tabs between cells."""
    lines: list[str] = []
    _render(node, lines, "")
    text = "\n".join(x.rstrip() for x in lines)
    return re.sub(r"\n{3,}", "\n\n", text).strip("\n")


def _render(node: Node, lines: list[str], mark: str) -> None:
    if not node.visible:
        return
    if node.tag == "line":
        lines.append(node.attrs.get("raw", ""))
        return
    if node.tag == "table":
        lines.append("")
        for row in _rows(node):
            lines.append("\t".join(re.sub(r"\s+", " ", c.text()).strip() for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and c.visible))
        lines.append("")
        return
    block = node.tag in BLOCKS
    inline: list[str] = []

    def flush() -> None:
        raw = "".join(inline)
        text = raw if node.tag == "pre" else re.sub(r"[ \t\r\f\v]*\n[ \t\r\f\v]*", " ", raw)
        for part in text.split("\x1e"):
            part = part if node.tag == "pre" else re.sub(r"\s+", " ", part).strip()
            if part:
                lines.append(mark + part)
        inline.clear()

    if block and node.tag not in ("li", "tr", "dt", "dd"):
        lines.append("")
    n = 0
    for c in node.children:
        if isinstance(c, str):
            inline.append(c)
        elif c.tag == "br":
            inline.append("\x1e")
        elif c.tag in BLOCKS or c.tag == "line":
            flush()
            n += c.tag == "li"
            _render(c, lines, f"{n}. " if c.tag == "li" and node.tag == "ol" else "- " if c.tag == "li" else "")
        elif c.visible:
            if any(isinstance(g, Node) and g.tag in BLOCKS for g in c.children):
                flush()
                _render(c, lines, "")
            else:
                inline.append(_inline(c))
    flush()
    if block and node.tag not in ("li", "tr", "dt", "dd"):
        lines.append("")


def _inline(node: Node) -> str:
    if not node.visible:
        return ""
    if node.tag == "br":
        return "\x1e"
    return "".join(c if isinstance(c, str) else _inline(c) for c in node.children)


def _rows(node: Node) -> list[Node]:
    out = []
    for c in node.children:
        if isinstance(c, Node) and c.visible:
            out += [c] if c.tag == "tr" else _rows(c)
    return out
