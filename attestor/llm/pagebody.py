"""The main body of web pages: a layout tree, visibility rules, rendering.

A passage is read into a tree: HTML by its tags, text by the tags that markup
would have given, implied from layout alone - blocks between blank lines,
labels between bars, columns of labels, paths to where the page stands, lists
of single words, headlines under a heading - never from listed phrases.
Visibility is then decided twice: some layouts are furniture by themselves;
every other line is furniture where the corpus says that it belongs to the
site and not to the article, because it stands beside different articles again
and again.  Notes of the article itself (bylines, reading times, disclaimers)
repeat as well and stay.  The renderer emits what is visible with block
spacing, lists and cells as they stood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.page_tree import FURNITURE, Node, build_html, hidden_lines, render
from attestor.llm.messages import may_hold_message, message, open_fields
from attestor.llm.sitelines import MONTHS, document_sites
from attestor.session import Scratch, spread

# Words of notes that belong to the article and come back on many
# pages - who wrote it, how long it is, what it is worth, where it was printed.
NOTE_LEADS = "by|words|text|texte|texto|photo|photos|foto|fotos|written by|reported by|von|par|por|escrito por|écrit par"
NOTE_WORDS = set("""
liability liable warranty guarantee gewähr garantie garantía garantías advice writer author opinions
corrections correction berichtigungen printed erschienen paru publicado edition ausgabe numéro número desk
""".split())
READING_TIME = r"(?:reading|read|lesezeit|lecture|lectura).*\d+\s*min|\d+\s*min\w*\s+(?:read|lesezeit|de lecture|de lectura)"
# end of fixed values

MARK = re.compile(r"^(?:(?:[•*–—\-»›▪◦‣]+|\(?\d{1,2}[.)])\s+)+")
BULLET = re.compile(r"^[•*–—\-»›▪◦‣]+\s+")
BAR = re.compile(r"\s+[|·>›»/•]\s+|\s*[|·›»]\s*")
PATH = re.compile(r"\s*[›»]\s*|\s+[>/]\s+")
PATH_START = re.compile(r"\W*\S+(?: \S+)?\s*[›»>/]")
LABEL = re.compile(r"[^\W\d_](?:[^\W\d_]|[ '’&\-])*\Z")
ENDS = re.compile(r"[.!?…:;。！？]['\"”’»)\]]*\Z")
SENTENCE = re.compile(r"(?<=[.!?…。])\s+")
MARKUP = re.compile(r"</(?:p|div|li|a|td|nav|h\d|span|ul|table|body|html|footer|aside|header)\s*>", re.I)
NOTE = re.compile(rf"(?:{NOTE_LEADS})\s*:?\s+\S+ \S+")
DIGIT = re.compile(r"\d")
TIME = re.compile(READING_TIME)
LETTERS, MONTHS_SET = re.compile(r"[^\W\d_]+"), set(MONTHS)
SERVER = re.compile(r"\S+/\d+(?:\.\d+)+\Z")


def plain(line: str) -> str:
    """A line in lower case, one space between words, without list and end marks."""
    x = " ".join(line.replace("’", "'").split()).lower()
    return MARK.sub("", x).rstrip(" \t\n .!…»›:")


def _key(x: str) -> str:
    return "".join(w for w in LETTERS.findall(x) if w not in MONTHS_SET)


def line_key(line: str) -> str:
    """What lines have in common that differ in case, marks and figures; empty without a letter."""
    return _key(plain(line))


def _label(x: str, words: int = 3) -> bool:
    """A few words without figures or an end."""
    return bool(LABEL.match(x)) and len(x.split()) <= words and not ENDS.search(x)


def _is_note(raw: str, x: str) -> bool:
    """A note of the article itself, or a message in place of one: neither is furniture."""
    words = x.split(" ")
    if NOTE.match(x) or not NOTE_WORDS.isdisjoint(words) or "'s" in x and "views" in words:
        return True
    if len(words) <= 5 and re.match(r"[^\W\d_]+ [^\W\d_\-]+, ", x) or ("min" in x and DIGIT.search(x) and TIME.search(x) or "/" in x and SERVER.match(x)):
        return True
    return open_fields(raw) or may_hold_message(raw) and any(message(s) for s in [raw, *SENTENCE.split(raw)])


def _words_only(x: str) -> bool:
    """Three single words or more, apart by commas, bars or number signs, with a label before them or none."""
    if ENDS.search(x):
        return False
    x = re.sub(r"^[^\W\d_]+(?:[- ][^\W\d_]+)?\s*:\s*", "", x)
    for mark in (r"\s*,\s*", r"\s*[|·/]\s*", r"\s*#"):
        parts = [p for p in re.split(mark, x) if p]
        if len(parts) >= 3 and all(re.fullmatch(r"[^\W\d_]+", p) for p in parts):
            return True
    return False


def _line_layout(raw: str) -> str:
    """The furniture tag that a line's own shape implies, or ``""``: nav, path, tags."""
    x = BULLET.sub("", raw.strip()).rstrip(" .!…»›")
    if "\t" in raw:
        return ""
    if "  " in x:
        cells = re.split(r" {2,}", x)
        if len(cells) >= 3 and all(c[:1].isupper() and _label(c) for c in cells) and not x.isupper():
            return "nav"
    marks = sum(map(x.count, "|·>›»/•,#"))
    if not marks:
        return ""
    words = x.count(" ") + 1
    bars = [p for p in BAR.split(x) if p] if 4 * marks >= words - 4 else []  # labels have three words at most
    if len(bars) >= 3 and all(map(_label, bars)):
        return "nav"
    path = [p for p in PATH.split(x) if p] if PATH_START.match(x) else []
    if len(path) >= 3 and _label(path[0], 2) and _label(path[1], 2):
        return "path"
    if len(path) == 2 and _label(path[0], 2) and re.search("[›»]", x):
        return "path"
    bare = x.rstrip(" .!…»›:")
    if 2 * marks >= words - 4 and _words_only(bare) and (bare.islower() or bare.isupper() or "#" in bare or re.match(r"[^\W\d_]+\s*:", bare)):
        return "tags"
    return ""


def _line(raw: str) -> tuple[str, str, bool, bool, bool]:
    """``(layout, key, note, label, open)`` of a line: what it looks like by itself."""
    x = plain(raw)
    bare = BULLET.sub("", raw.strip())
    return _line_layout(raw), _key(x), _is_note(raw, x), _label(bare), not ENDS.search(bare)


_short_line = lru_cache(1 << 16)(_line)
_short_layout = lru_cache(1 << 16)(_line_layout)


def line_layout(raw: str) -> str:
    return _short_layout(raw) if len(raw) <= 120 else _line_layout(raw)


def line_facts(raw: str) -> tuple[str, str, bool, bool, bool]:
    return _short_line(raw) if len(raw) <= 120 else _line(raw)  # long lines seldom come back: they would fill the cache


def build_text(text: str) -> Node:
    """The tree of a passage: blocks of lines with implied tags; every line is a leaf with its number and its facts."""
    root, block, blocks = Node("body"), [], []
    for n, line in enumerate([*text.split("\n"), ""]):
        if line.strip():
            leaf = Node("line", {"n": str(n), "raw": line})
            leaf.facts = line_facts(line)
            block.append(leaf)
        elif block:
            blocks.append(block)
            block = []
    told = [i for i, b in enumerate(blocks) if any(len(x.attrs["raw"]) >= 60 and not x.facts[4] and not x.facts[2] for x in b)]
    for i, b in enumerate(blocks):
        between = bool(told) and told[0] < i < told[-1]
        root.children.append(Node("div", {"implied": _block_layout(b, between), "between": "1" if between else ""}, b))
    return root


def _block_layout(lines: list[Node], between: bool) -> str:
    """The tag that a block's shape implies: nav (a column of labels), listed (a label over other lines), or ``""``."""
    if any("\t" in x.attrs["raw"] for x in lines):
        return ""
    if len(lines) >= 4 and all(x.facts[3] for x in lines) and not between:
        return "nav"
    if len(lines) >= 2 and _label(plain(lines[0].attrs["raw"]), 5) and all(x.facts[4] for x in lines[1:]):
        return "listed"
    return ""


HIDE, SITE, ANY = 0, 1, 2  # furniture as it is; if its site repeats it; if several sites do


def page_lines(text: str) -> list[tuple[int, int, str, bool]]:
    """``(line, how, key, own)`` of the lines that can be furniture: how that is decided, by which key, and whether it is the line's own."""
    out: list[tuple[int, int, str, bool]] = []
    gone: set[int] = set()
    if MARKUP.search(text):
        gone = set(hidden_lines(build_html(text)))
        text = re.sub(r"<[^>\n]*>", " ", text)
    for block in build_text(text).children:
        tag, how = block.attrs["implied"], SITE if block.attrs["between"] else ANY
        head = block.children[0].facts[1]
        for i, leaf in enumerate(block.children):
            n, (layout, key, note, _, _) = int(leaf.attrs["n"]), leaf.facts
            if n in gone or tag == "nav" or layout and not (note and layout == "nav"):
                out.append((n, HIDE, "", False))
            elif not note and "\t" not in leaf.attrs["raw"]:
                if key:
                    out.append((n, how, key, True))
                if tag == "listed" and i and head:
                    out.append((n, how, head, False))
    return out


def hide(root: Node, gone: set[int]) -> Node:
    """Visibility of a text's tree: the lines named are switched off."""
    for block in root.children:
        for line in block.children:
            line.visible = int(line.attrs["n"]) not in gone
    return root


def body_text(text: str, gone: set[int]) -> str:
    """What is left of a web page's passage without its furniture lines; HTML is rendered by its own tree."""
    if MARKUP.search(text):
        tags_only = lambda x: "".join(re.findall(r"<[^>]*>", x))
        root = build_html("\n".join(tags_only(x) if n in gone else x for n, x in enumerate(text.split("\n"))))
        stack = [root]
        while stack:
            node = stack.pop()
            node.visible = node.visible and node.tag not in FURNITURE
            stack += [c for c in node.children if isinstance(c, Node)]
        return render(root)
    return render(hide(build_text(text), gone))


def is_web(content_type: Column) -> Column:
    """Whether a content type is a web page's; null, empty and odd ones are."""
    kind = F.lower(F.trim(F.split(F.coalesce(content_type, F.lit("")), ";").getItem(0)))
    return ~(kind.contains("pdf") | (kind.startswith("text/") & ~kind.contains("html") & ~kind.contains("xml")) | kind.contains("msword") | kind.contains("officedocument"))


def _other_documents(fetches: DataFrame) -> DataFrame:
    """Documents that are no web pages: PDF or plain text by every row that says."""
    typed = fetches.where("document_id is not null").groupBy("document_id").agg(F.max(is_web(F.col("content_type"))).alias("web"))
    return typed.where(~F.col("web")).select("document_id")


def hash64(key: str) -> int:
    return int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)


def furniture(passages: DataFrame, fetches: DataFrame, sources: DataFrame, pages: int = 3, broadcast_bytes: int = 8 << 20, salts: int = 32) -> DataFrame:
    """``(passage_id, line_no)`` of the site furniture in web pages' passages.

    A line is furniture by its layout (see ``page_lines``), or because its site
    repeats it beside ``pages`` different articles, or, but between an
    article's paragraphs, ``pages`` sites do; an article is told by the longest
    line of the passage, so copies count once.  Case, marks and figures do not
    matter.  Repeated rows count once; null and empty texts have none;
    documents that no fetch names are web pages of an unknown site.  The texts
    are read where they lie, and only hashes of lines are shuffled.
    """
    scratch = Scratch(passages.sparkSession, "pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 16)(hash64)
        kind = pa.list_(pa.struct([("n", pa.int32()), ("how", pa.int8()), ("k", pa.int64()), ("own", pa.bool_())]))
        for batch in batches:
            rows, article = [], []
            for t in batch.column(2).to_pylist():
                found = page_lines(t)
                rows.append([{"n": n, "how": how, "k": known(k) if k else 0, "own": own} for n, how, k, own in found])
                article.append(hash64(max(t.split("\n"), key=len).strip()) if found else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(article, pa.int64()), pa.array(rows, kind)], names=["passage_id", "document_id", "c", "lines"])

    texts = passages.where("text is not null and text != ''").select(F.col("passage_id").cast("long"), F.col("document_id").cast("long"), "text")
    read = spread(texts).mapInArrow(run, "passage_id long, document_id long, c long, lines array<struct<n:int,how:tinyint,k:long,own:boolean>>")
    site = document_sites(fetches, sources).select("document_id", F.xxhash64("site").alias("s"))
    read = read.dropDuplicates(["passage_id"]).join(_other_documents(fetches), "document_id", "left_anti").join(site, "document_id", "left")
    lines = scratch.save(read.select("passage_id", "c", F.coalesce("s", F.lit(0)).alias("s"), F.explode("lines").alias("x")).select("passage_id", "c", "s", "x.*"))

    asked = lines.where(F.col("how") != HIDE)
    # each (site, line, article) once: a line of a third of all pages is spread over its articles
    beside = scratch.save(asked.where("own").select("s", "k", "c").distinct())
    own = beside.where("s != 0").groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") >= pages).select("s", "k")
    sites = beside.groupBy("s", "k").agg(F.min("c").alias("c")).groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where((F.col("n") >= pages) & (F.col("lo") != F.col("hi")))
    articles = beside.join(sites.select("k"), "k", "left_semi").select("k", "c").distinct().groupBy("k").agg(F.count("*").alias("n"))
    anywhere = articles.where(F.col("n") >= pages).select("k")
    found = lines.where(F.col("how") == HIDE).select("passage_id", "n")
    for table, keys, rows in ((own, ["s", "k"], asked), (anywhere, ["k"], asked.where(F.col("how") == ANY))):
        table = scratch.save(table)
        if scratch.bytes(table) <= broadcast_bytes:
            hit = rows.join(F.broadcast(table), keys, "left_semi")
        else:
            # a line of a third of all pages is spread over the salts
            salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            hit = rows.withColumn("salt", F.pmod("passage_id", F.lit(salts)).cast("int")).join(salted, [*keys, "salt"], "left_semi")
        found = found.union(hit.select("passage_id", "n"))
    return found.distinct().select("passage_id", F.col("n").alias("line_no"))


def main_bodies(passages: DataFrame, fetches: DataFrame, sources: DataFrame, pages: int = 3) -> DataFrame:
    """``passages`` with ``body``: the text without furniture.

    Null texts give null; passages of PDF and plain text keep their text; a
    passage of furniture alone has an empty body.  Repeated rows stay.
    """
    lines = furniture(passages, fetches, sources, pages).groupBy("passage_id").agg(F.collect_list("line_no").alias("_gone"))  # within one passage: bounded

    @F.pandas_udf("string")
    def body(text: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([body_text(t, set() if g is None else set(g)) if isinstance(t, str) else None for t, g in zip(text, gone)], dtype=object)

    others = _other_documents(fetches).withColumn("_not_web", F.lit(True))
    wide = passages.join(lines, "passage_id", "left").join(others, "document_id", "left")
    return wide.select(*[F.col(c) for c in passages.columns], F.when(F.col("_not_web"), F.col("text")).otherwise(body("text", "_gone")).alias("body"))
