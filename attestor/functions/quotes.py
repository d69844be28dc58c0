"""Finding quotes in texts: anchoring with offsets, and matching without.

A text is an array of lower-case words with their spans; a quote is a list of
fragments, each a list of words.  All places of each fragment are looked up by
its rarest word, and all chains of fragments are followed at once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from attestor.functions.arrow import arrow_udf

# How a quote leaves text out, the footnote marks that pages keep
# and quotes drop, and how much an ellipsis may skip (bytes of words and single
# spaces).
ELLIPSES = r"\[\s*(?:\.\.\.|…)\s*\]|\.\.\.|…"
FOOTNOTES = r"\[(?:\d{1,3}|[a-z])\]"
REACH = 400
# end of fixed values

_WORD = re.compile(r"[^\W_]+")


def _fragments(quote: str) -> list[list[str]]:
    parts = ([w.lower() for w in _WORD.findall(p)] for p in re.split(ELLIPSES, quote))
    return [p for p in parts if p]


class _Words:
    """The words of a text, their spans and their places by word."""

    def __init__(self, text: str, footnotes: bool) -> None:
        if footnotes and "[" in text:
            text = re.sub(FOOTNOTES, lambda m: " " * len(m[0]), text)
        found = list(_WORD.finditer(text))
        self.words = [m[0].lower() for m in found]
        self.spans = [m.span() for m in found]
        self.byte = np.cumsum([0, *(len(w.encode()) + 1 for w in self.words)])  # where each word begins
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.places.setdefault(w, []).append(i)

    def of(self, fragment: list[str]) -> np.ndarray:
        """First words of all places of a fragment, in order."""
        rare = min(range(len(fragment)), key=lambda i: len(self.places.get(fragment[i], ())))
        starts = (p - rare for p in self.places.get(fragment[rare], ()))
        return np.array([s for s in starts if s >= 0 and self.words[s : s + len(fragment)] == fragment], "i8")

    def chain(self, fragments: list[list[str]], reach: int | None) -> tuple[int, int] | None:
        """First and last word of the first chain: each fragment at its next place, ``reach`` bytes away at most."""
        first = self.of(fragments[0])
        end = first + len(fragments[0])
        for f in fragments[1:]:
            at = self.of(f)
            n = np.searchsorted(at, end)
            ok = n < len(at)
            first, end, n = first[ok], end[ok], n[ok]
            near = self.byte[at[n]] - self.byte[end] <= reach if reach is not None else np.ones(len(n), bool)
            first, end = first[near], at[n[near]] + len(f)
        return (int(first[0]), int(end[0]) - 1) if len(first) else None


def locate(quote: str | None, text: str | None) -> tuple[int, int] | None:
    """Code-point span of a quote in a text, case, spacing and punctuation aside.

    Fragments between ellipses must follow in order, each within REACH of the
    one before; footnote marks of the text are skipped.  None without words or
    a place.
    """
    fragments = _fragments(quote or "")
    if not fragments or not text:
        return None
    words = _Words(text, True)
    hit = words.chain(fragments, REACH)
    return (words.spans[hit[0]][0], words.spans[hit[1]][1]) if hit else None


@arrow_udf("struct<char_start:int,char_end:int>")
def locate_quote(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [locate(q if isinstance(q, str) else None, t if isinstance(t, str) else None) or (None, None) for q, t in zip(quote, text)]
    return pd.DataFrame(found, columns=["char_start", "char_end"]).astype("Int32")


def found(quote: str | None, text: str | None) -> bool | None:
    """Whether a cited quote is in a text; fragments may lie any distance apart."""
    if quote is None or text is None:
        return None
    fragments = _fragments(quote)
    return bool(fragments) and _Words(text, False).chain(fragments, None) is not None


@arrow_udf("boolean")
def quote_found(quote: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([found(q if isinstance(q, str) else None, t if isinstance(t, str) else None) for q, t in zip(quote, text)], dtype="boolean")
