"""Reports in Markdown: sections, references, prose, list items, claims."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from attestor.functions.arrow import arrow_udf
from attestor.functions.passages import split_sentences

# Patterns and limits that reports are measured by - URLs,
# references and their headings, bibliography lines, headings and sentences of
# counter-evidence, the shortest claim in bytes, the widest range of numbers.
URL = r"https?://[^\s<>\"'`\]\[{}|\\^]+"
URL_TAIL = ".,;:!?*_'\""
REFERENCE_HEADING = (
    r"(?i)^(?:(?:key|selected|primary|full)\s+)?(?:references|sources|bibliography|works cited|citations|sources consulted|sources cited)"
    r"(?:\s+(?:and|&)\s+(?:sources|references|further reading|notes|citations))?(?:\s*\(.*\))?:?$"
)
HEADING_NUMBER = r"^(?:[IVXLC]+|\d+(?:\.\d+)*)[.)]?\s+"
COUNTER_HEADING = (
    r"(?i)counter|contradict|disconfirm|disput|critic|skeptic|null result|limitation|debunk|rebut|objection|contested|unverified|unsubstantiated"
    r"|not (?:been )?(?:verified|substantiated|established)|weak(?:ness|er)? evidence|evidence against|alternative explanation"
)
COUNTER_SENTENCE = (
    r"(?i)\b(?:no (?:credible |documentary |direct |hard |public |known |independent )?evidence"
    r"|not (?:been )?(?:documented|verified|substantiated|established|proven|supported|replicated)|unverified|unsubstantiated|unproven|disputed"
    r"|contradict\w*|counter-?evidence|counter-?argument\w*|disconfirm\w*|failed to replicate|did not replicate|null results?|debunk\w*"
    r"|critics (?:argue|note|say|point|contend|counter)|overstate[sd]?|no (?:documentary )?record|remains? (?:unclear|speculative|unconfirmed|unproven)"
    r"|cannot be (?:shown|confirmed|verified|established)|lacks? (?:of )?(?:evidence|documentation)|lack of (?:evidence|documentation))\b"
)
VOLUME_PAGES = r"\b\d+\s*(?:,\s*)?(?:no\.\s*\d+\s*)?\((?:1[5-9]|20)\d\d\)\s*:\s*\d+|:\s*\d+\s*[-–]\s*\d+\.?$"
PUBLISHER = r"\([^()]*(?:Press|Publishing|Publishers|Books|Bloomsbury|Norton|Random House|Knopf|Penguin|Simon & Schuster|HarperCollins|Wiley|Routledge)[^()]*\)\.?$"
SOURCE_LEAD = r"(?i)^(?:sources?|source text|summary via|see also|via)\b"
YEAR_IN_BRACKETS = r"\([^()]*\b(?:1[5-9]\d\d|20[0-2]\d)\b[^()]*\)"
SOURCES_BLOCK = ("SOURCES_START", "SOURCES_END")
CRITIC_HEADING = "critic notes"
RUN_LINE = r"(?m)^\*Generated: [^\n]*\| Backend: [^\n]*\*[ \t]*$"
LEAST_CLAIM, WIDEST_RANGE = 60, 20
# end of fixed values

SECTION_TYPE = "array<struct<ord:int,level:int,heading:string,body:string>>"
_HEAD = re.compile(r"(#{1,6})\s+(\S.*)?")
_URL = re.compile(URL)
_LINK = re.compile(r"\[([^\]]+)\]\((https?://[^)\s]+)\)")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)]|\[\d+\])\s+")
_NUMBER = re.compile(r"\s*(?:\[(\d+)\]|(\d+)[.)])\s")
_CITED = re.compile(r"\[([\d\s,–-]*\d)\]")
_BIBLIOGRAPHY = [re.compile(p) for p in (VOLUME_PAGES, PUBLISHER, SOURCE_LEAD)]
_YEAR, _COUNTER, _COUNTER_HEAD, _REFERENCES = map(re.compile, (YEAR_IN_BRACKETS, COUNTER_SENTENCE, COUNTER_HEADING, REFERENCE_HEADING))


def bare(text: str) -> str:
    """Without emphasis and code marks."""
    return re.sub(r"[*_`]+", "", text).strip()


def _heading(line: str) -> tuple[int, str] | None:
    m = _HEAD.fullmatch(line.rstrip())
    return (len(m[1]), re.sub(HEADING_NUMBER, "", bare(re.sub(r"\s*#*$", "", m[2] or "")))) if m else None


def split_sections(text: str) -> list[dict]:
    """Sections by heading, outside code fences; text before the first has level 0."""
    out = [{"ord": 0, "level": 0, "heading": "", "body": []}]
    fenced = False
    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        head = None if fenced else _heading(line)
        if head:
            out.append({"ord": len(out), "level": head[0], "heading": head[1], "body": []})
        else:
            out[-1]["body"].append(line)
    for s in out:
        s["body"] = "\n".join(s["body"]).strip("\n")
    return [s for s in out if s["ord"] or s["body"]]


@arrow_udf(SECTION_TYPE)
def sections(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_sections(t) if isinstance(t, str) else None)


def trim_url(url: str) -> str:
    """Without closing punctuation and unbalanced brackets."""
    while url and (url[-1] in URL_TAIL or (url[-1] == ")" and url.count(")") > url.count("("))):
        url = url[:-1]
    return url


def urls_of(text: str) -> list[str]:
    return [u for u in map(trim_url, _URL.findall(text)) if len(u) > len("https://")]


@arrow_udf("array<string>")
def extract_urls(text: pd.Series) -> pd.Series:
    """URLs of a text in order, trimmed."""
    return text.map(lambda t: urls_of(t) if isinstance(t, str) else None)


def prose_blocks(text: str) -> list[str]:
    """Paragraphs and list items on one line each, without tables, code, rules and headings."""
    out: list[list[str]] = [[]]
    for line in re.sub(r"(?s)```.*?```", "", text).split("\n"):
        t = line.strip()
        item = _ITEM.match(line)
        if not t or t == "---" or t[0] == "|" or _heading(t):
            out.append([])
        elif item:
            out.append([line[item.end() :].strip()])
        else:
            out[-1].append(t.removeprefix("> "))
    return [" ".join(b) for b in out if b]


def count_blocks(text: str) -> int:
    """List items and paragraphs, tables and rules aside."""
    marks = []  # of each line: i an item, p text of a paragraph, - neither
    for line in text.split("\n"):
        t = line.strip()
        marks.append("i" if _ITEM.match(line) and t != "---" else "-" if not t or t == "---" or t[0] == "|" else "p")
    return len(re.findall("i|p+", "".join(marks)))


def _listed(lines: list[str]) -> list[dict]:
    """Entries ``num, text, urls`` of a reference list; lines without a mark carry the one above on."""
    out: list[dict] = []
    for line in lines:
        t = line.strip()
        if not t or t == "---" or _heading(t):
            continue
        mark, number = _ITEM.match(line), _NUMBER.match(line)
        if mark:
            out.append({"num": int(number[1] or number[2]) if number else 0, "text": line[mark.end() :].strip()})
        elif out:
            out[-1]["text"] += " " + t
    return [e | {"urls": urls_of(e["text"])} for e in out]


def _numbers(cited: str) -> list[int]:
    """``1, 3-5`` as 1, 3, 4, 5; a range of WIDEST_RANGE or more names nothing."""
    out: list[int] = []
    for part in re.split(r"\s*,\s*", cited.replace("–", "-").strip()):
        ends = [int(x) for x in re.split(r"\s*-\s*", part) if x.isdigit()]
        if len(ends) in (1, 2) and 0 < ends[0] <= ends[-1] < ends[0] + WIDEST_RANGE:
            out += range(ends[0], ends[-1] + 1)
    return out


def bibliography_like(line: str) -> bool:
    """A line that is a reference: volume (year): pages, a closing publisher, or a source's lead."""
    return any(p.search(line) for p in _BIBLIOGRAPHY)


def parse_report(text: str) -> dict:
    """Body, sections, references, listed sources, critic notes, claims and counter-evidence of a report.

    A claim is a sentence of LEAST_CLAIM bytes that carries a URL, a number of
    the reference list or a year in brackets, and is no reference itself; its
    ``cites`` are the URLs and references named.
    """
    run = re.search(RUN_LINE, text)
    if run:
        text = text[run.end() :].lstrip(" \t\n").removeprefix("---").lstrip("\n")
    sources: list[str] = []
    start, _, rest = text.partition(SOURCES_BLOCK[0])
    block, end, after = rest.partition(SOURCES_BLOCK[1])
    if end:
        try:
            entries = json.loads(block.strip())
            sources = [str(e["url"]).strip() for e in entries if isinstance(e, dict) and str(e.get("url") or "").strip()] if isinstance(entries, list) else []
        except ValueError:
            pass
        text = re.sub(r"```(?:json)?\s*\Z", "", start) + re.sub(r"\A\s*```", "", after)
    lines: dict[str, list[str]] = {"body": [], "references": [], "critic": []}
    into, depth = "body", 0
    for line in text.split("\n"):
        head = _heading(line)
        if head and (head[1].lower() == CRITIC_HEADING or _REFERENCES.match(head[1]) and not (into != "body" and head[0] > depth)):
            into, depth = "critic" if head[1].lower() == CRITIC_HEADING else "references", head[0]
            continue
        if head and head[0] <= depth:
            into, depth = "body", 0
        lines[into].append(line)
    body = "\n".join(lines["body"]).rstrip("\n")
    refs = _listed(lines["references"])
    named: dict[int, list[str]] = {}
    for r in refs:
        named.setdefault(r["num"], []).append(r["text"])
    claims, counter = [], 0
    for block in prose_blocks(body):
        for s in split_sentences(block):
            counter += bool(_COUNTER.search(s))
            said = bare(_LINK.sub(r"\1", s))
            if len(said.encode()) < LEAST_CLAIM or bibliography_like(said):
                continue
            cites = urls_of(s) + [f"[{n}] {t}" for m in _CITED.findall(s) for n in _numbers(m) for t in named.get(n, ())]
            if cites or _YEAR.search(s):
                claims.append({"text": said, "cites": list(dict.fromkeys(cites))})
    parts = split_sections(body)
    against = [count_blocks(p["body"]) for p in parts if _COUNTER_HEAD.search(p["heading"])]
    return {
        "urls": urls_of(body) + [u for r in refs for u in r["urls"]] + sources, "refs": refs, "listed": len(refs) + len(sources), "claims": claims, "critic": "\n".join(lines["critic"]).strip(),
        "counter_items": sum(against), "counter_sentences": counter, "sections": len(parts),
    }


REPORT_TYPE = (
    "struct<urls:array<string>,refs:array<struct<num:int,text:string,urls:array<string>>>,listed:int,claims:array<struct<text:string,cites:array<string>>>,"
    "critic:string,counter_items:int,counter_sentences:int,sections:int>"
)


@arrow_udf(REPORT_TYPE)
def report_parts(text: pd.Series) -> pd.DataFrame:
    names = ["urls", "refs", "listed", "claims", "critic", "counter_items", "counter_sentences", "sections"]
    return pd.DataFrame([parse_report(t) if isinstance(t, str) else dict.fromkeys(names) for t in text], columns=names)


def bibliography_line(line: Column) -> Column:
    """``bibliography_like`` as an expression."""
    return line.rlike(VOLUME_PAGES) | line.rlike(PUBLISHER) | line.rlike(SOURCE_LEAD)


def list_items(raw: str, none: str = "none") -> list[str]:
    """Bullets or numbers with their indented continuation; other text is one item."""
    if raw.strip().lower().rstrip(".") in ("", none):
        return []
    out: list[str] = []
    for line in raw.split("\n"):
        m = re.match(r"^\s{0,3}(?:[-*•]|\d+[.)])\s+(.*)", line)
        if m:
            out.append(m[1].strip())
        elif out and line.strip() and line[0] in " \t":
            out[-1] += " " + line.strip()
    return out or [re.sub(r"\s+", " ", raw).strip()]


@arrow_udf("array<string>")
def critic_items(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: list_items(t) if isinstance(t, str) else None)


def report_between(raw: str, begin: str = "<report>", end: str = "</report>") -> dict:
    """Text from the first begin to the last end mark, and ok, unterminated, missing or empty."""
    a = raw.find(begin)
    if a < 0:
        return {"status": "missing", "report": raw.strip()}
    b = raw.rfind(end)
    text = raw[a + len(begin) : b if b > a else len(raw)].strip()
    return {"status": "unterminated" if b <= a else "ok" if text else "empty", "report": text}


@arrow_udf("struct<status:string,report:string>")
def report_section(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([report_between(t) if isinstance(t, str) else {"status": None, "report": None} for t in raw], columns=["status", "report"])
