"""Cutting texts: passages with exact offsets, chunks for extraction, sentences."""

from __future__ import annotations

import re

import pandas as pd
from attestor.functions.arrow import arrow_udf

TARGET, SHORT, MOST = 1_500, 300, 2_000  # characters of a passage
CHUNK, CHUNKS = 6_000, 8  # characters and number of extraction chunks: the defaults of ``split_chunks``

# Abbreviations that end in a stop without ending a sentence.
ABBREVIATIONS = """
u.s u.k e.g i.e dr mr mrs ms prof vs al st jr sr no vol pp p ed eds inc co corp fig cf ca approx gen sen rep col lt sgt gov rev u.n
""".split()

_PARAGRAPH = re.compile(r"\n[ \t]*\n\s*")
_END = re.compile(r"[.!?]+[\"'”’)\]]*(?=\s+[\"'“‘(\[]?[A-Z0-9])")
PASSAGE_TYPE = "array<struct<ord:int,char_start:int,char_end:int,text:string>>"


def _pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """A paragraph's span cut into spans of at most MOST characters."""
    out = []
    while end - start > MOST:
        window = text[start : start + MOST]
        cut = max((m.end() for m in _END.finditer(window) if m.end() > MOST // 2), default=0)
        cut = cut or window.rfind(" ", MOST // 2) or 0
        cut = cut if cut > 0 else MOST
        out.append((start, start + len(window[:cut].rstrip())))
        start += cut
        while start < end and text[start].isspace():
            start += 1
    if start < end:
        out.append((start, end))
    return out


def split_passages(text: str) -> list[tuple[int, int, int, str]]:
    """``(ord, start, end, text)``: paragraphs packed to about TARGET characters.

    Offsets count code points; a short paragraph may still join up to MOST, a
    longer one is cut at a sentence end, else a space, else hard; a short tail
    joins the passage before it.
    """
    spans, at = [], 0
    for gap in [*_PARAGRAPH.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        a, b = at, stop
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans += _pieces(text, a, b)
        at = gap.end() if gap else stop
    packed: list[list[int]] = []
    for a, b in spans:
        size = b - packed[-1][0] if packed else 0
        if packed and (size <= TARGET or (min(b - a, packed[-1][1] - packed[-1][0]) < SHORT and size <= MOST)):
            packed[-1][1] = b
        else:
            packed.append([a, b])
    return [(n, a, b, text[a:b]) for n, (a, b) in enumerate(packed)]


@arrow_udf(PASSAGE_TYPE)
def passages(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("ord", "char_start", "char_end", "text"), p)) for p in split_passages(t)] if isinstance(t, str) else None)


def split_chunks(text: str, size: int = CHUNK, most: int | None = CHUNKS) -> list[str]:
    """Paragraphs joined by blank lines into at most ``most`` chunks of ``size`` (None: as many as it takes).

    The limit is the extraction's budget: what lies beyond it is not sent.
    """
    out: list[str] = []
    for p in (p.strip() for p in _PARAGRAPH.split(text)):
        while p:
            piece, p = p[:size], p[size:].lstrip()
            if out and len(out[-1]) + 2 + len(piece) <= size:
                out[-1] += "\n\n" + piece
            elif most is not None and len(out) == most:
                return out
            else:
                out.append(piece)
    return out


@arrow_udf("array<string>")
def chunks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_chunks(t) if isinstance(t, str) else None)


_STOP = re.compile(r"[.!?][\"')\]*_”’]*(?=\s)")
_OPENS = "\"'([*_“‘"


def split_sentences(text: str) -> list[str]:
    """Sentences; a stop after an abbreviation or an initial, or before a small letter, ends none."""
    ends = [0]
    for m in _STOP.finditer(text):
        following = text[m.end() :].lstrip()[:1] if m.end() + 1 >= len(text) or text[m.end() + 1].isspace() else text[m.end() + 1]
        if following and not (following.isupper() or following.isdecimal() or following in _OPENS):
            continue
        word = re.split(r"[\s(]", text[ends[-1] : m.start()])[-1].strip("\"'*_(").lower()
        if m[0][0] == "." and (len(word) == 1 and word.isalpha() or word in ABBREVIATIONS):
            continue
        ends.append(m.end())
    return [s for s in (text[a:b].strip() for a, b in zip(ends, [*ends[1:], len(text)])) if s]


@arrow_udf("array<string>")
def sentences(text: pd.Series) -> pd.Series:
    return text.map(lambda t: split_sentences(t) if isinstance(t, str) else None)
