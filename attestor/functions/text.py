"""Text expressions: words, information, shared terms, shingles and SimHash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions.arrow import arrow_udf

# Words that do not make two statements alike.
STOP_WORDS = """
that this with from have been were which their there they than also into more most such some other
about after before over under when what where while these those would could should will each only many much very
between through during because does said says them then upon within without across among being both even
like made make same than very well
""".split()


def words(text: Column) -> Column:
    """Lower-case words of letters and decimal digits, in order; null for null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def normal(text: Column) -> Column:
    """Words joined and bounded by single spaces."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def quote_key(text: Column) -> Column:
    """The trimmed normal form; null when no word is left."""
    return F.nullif(F.array_join(words(text), " "), F.lit(""))


def informative(text: Column) -> Column:
    """1 for short or varied texts, down to 0.2 for texts of few distinct words."""
    w = words(text)
    share = F.size(F.array_distinct(w)) / F.size(w) / F.lit(0.25)
    return F.when(F.size(w) < 40, 1.0).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), share)))


def terms(text: Column) -> Column:
    """Distinct words of four bytes or more, or with a digit, that are no stop words."""
    w = F.array_distinct(words(text))
    return F.filter(w, lambda x: ((F.octet_length(x) >= 4) | x.rlike(r"\p{Nd}")) & ~x.isin(STOP_WORDS))


def share_term(a: Column, b: Column) -> Column:
    return F.arrays_overlap(terms(a), terms(b))


def clean_text(text: Column) -> Column:
    """Trimmed, without NUL; page breaks are paragraph breaks, three newlines two."""
    t = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"\s*\f\s*", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct word n-grams joined by one space; the whole text if shorter."""
    w = words(text)
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(n >= size, F.array_distinct(grams)).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


_FNV, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # fixed values of FNV-1a


def _low_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() and not (c.isnumeric() and not c.isdecimal()) else " " for c in text.lower()).split()


def gram_sums(grams: list[str]) -> np.ndarray:
    """For each of 64 bits, how many more of the grams' FNV-1a hashes have it set than not."""
    if not grams:
        return np.zeros(64, "i8")
    raw = [g.encode() for g in grams]
    longest = max(map(len, raw))
    flat = np.zeros((len(raw), longest), "u1")
    for i, b in enumerate(raw):
        flat[i, : len(b)] = np.frombuffer(b, "u1")
    length = np.array([len(b) for b in raw])
    h = np.full(len(raw), _FNV)
    with np.errstate(over="ignore"):
        for k in range(longest):
            live = k < length
            h[live] = (h[live] ^ flat[live, k].astype("u8")) * _PRIME
    bits = ((h[:, None] >> np.arange(64, dtype="u8")) & np.uint64(1)).astype("i8")
    return (2 * bits - 1).sum(0)


def simhash_of(text: str | None, size: int = 3) -> int | None:
    """64-bit SimHash over word shingles hashed with FNV-1a; 0 for no word."""
    if text is None:
        return None
    low = _low_words(text)
    if not low:
        return 0
    on = gram_sums([" ".join(low[i : i + size]) for i in range(max(1, len(low) - size + 1))]) > 0
    value = int((on.astype("u8") << np.arange(64, dtype="u8")).sum(dtype="u8"))
    return value - (1 << 64) if value >= 1 << 63 else value


@arrow_udf("struct<sums:array<int>,head:array<string>,tail:array<string>>")
def piece_grams(text: pd.Series) -> pd.DataFrame:
    """Of a piece of a text: the sums of its three-word shingles, and its first and last two words."""
    rows = []
    for t in text:
        low = _low_words(t) if isinstance(t, str) else []
        rows.append((gram_sums([" ".join(low[i : i + 3]) for i in range(len(low) - 2)]).astype("i4"), low[:2], low[-2:]))
    return pd.DataFrame(rows, columns=["sums", "head", "tail"])


@arrow_udf("array<int>")
def seam_grams(tail: pd.Series, head: pd.Series) -> pd.Series:
    """The sums of the shingles across the seam of two pieces, by the last words of one and the first of the next."""
    out = []
    for t, h in zip(tail, head):
        low = [*(t if t is not None else ()), *(h if h is not None else ())]
        n = len(t) if t is not None else 0
        out.append(gram_sums([" ".join(low[i : i + 3]) for i in range(len(low) - 2) if i < n < i + 3]).astype("i4"))
    return pd.Series(out)


def simhash_of_sums(sums: list[str]) -> Column:
    """The SimHash of 64 columns of summed shingles."""
    return F.expr(" | ".join(f"if({c} > 0, shiftleft(1L, {i}), 0L)" for i, c in enumerate(sums)))


@arrow_udf("long")
def simhash(text: pd.Series) -> pd.Series:
    return text.map(simhash_of, na_action="ignore").astype("Int64")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))
