"""Passages with residue in place of content.

Two kinds of evidence.  Detectors read the sentences themselves: template
fields left unfilled, filler, and messages (``messages``).  Comparison needs no
wording: every document's terms are held against the terms of its address slug
and title; one of little information that shares none, while the same text
with other figures answers other addresses too, is a canned response.  Copies
on one host and the fetch's own status and error count as further evidence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.messages import may_hold_message, message, open_fields
from attestor.llm.pagebody import SENTENCE, hash64, line_layout, plain
from attestor.llm.sitelines import host_of
from attestor.session import Scratch, spread

# Syllables and words of pseudo-Latin, words of keyboard filler.
LATIN = "lorem ipsum dolor sit amet um vel is tur lor ali per do con at qua nis ens mi re et in ut ad e ex cum sed non ac us a i o".split()
LATIN_WORDS = set("""
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam
quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum
fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
""".split())
KEYBOARD = set("asdf asdfgh qwerty qwertz foo bar baz test blah bla".split())
# end of fixed values

LATIN_WORD = re.compile("(?:" + "|".join(sorted(LATIN, key=len, reverse=True)) + r")+\Z")
TERM = re.compile(r"[^\W\d_]{3,}")


@lru_cache(1 << 16)
def _latin_word(w: str) -> bool:
    return w in LATIN_WORDS or bool(LATIN_WORD.match(w))


def latin(line: str, run: int = 6) -> bool:
    """Pseudo-Latin: ``run`` words of three letters or more in a row that are made of its syllables."""
    n = 0
    for w in TERM.findall(line.lower()):
        n = n + 1 if _latin_word(w) else 0
        if n >= run:
            return True
    return False


def repeated(sentence: str) -> bool:
    """Keyboard filler, or one word or two said three times and more that make up half of the sentence."""
    words = [w.strip(".,;:!?…") for w in sentence.lower().split()]
    if len(words) < 3:
        return False
    if sum(w in KEYBOARD or w.strip("x") == "" and len(w) >= 3 for w in words) == len(words):
        return True
    for size in (1, 2):
        best = n = 0
        for a, b in zip(words, words[size:]):
            n = n + 1 if a == b and a.isalpha() else 0
            best = max(best, n)
        if best >= 2 * size and 2 * (best + size) >= len(words) and "\t" not in sentence:
            return True
    return False


def _may_repeat(line: str) -> bool:
    words = line.lower().split()
    return any(a == b for a, b in zip(words, words[1:])) or any(a == b and c == d for a, b, c, d in zip(words, words[2:], words[1:], words[3:])) or not KEYBOARD.isdisjoint(words)


@lru_cache(1 << 16)
def _short_residue(line: str) -> bool:
    return _line_residue(line)


def _line_residue(line: str) -> bool:
    if open_fields(line) or latin(line):
        return True
    told, run = may_hold_message(line), _may_repeat(line)
    return (told or run) and any(told and message(s) or run and repeated(s) for s in [line, *SENTENCE.split(line)])


def content_lines(text: str) -> list[str]:
    """Non-blank lines that are no furniture by their layout."""
    return [x for x in text.split("\n") if x.strip() and not line_layout(x)]


def has_residue(lines: list[str]) -> bool:
    """Whether any line or sentence stands for content."""
    return any(_short_residue(x) if len(x) <= 120 else _line_residue(x) for x in lines)


def _terms(lines: list[str]) -> tuple[list[int], int, int]:
    """Hashes of the distinct terms of lines, how many words they are in all, and their shape's hash."""
    body = "\n".join(lines).lower()
    words = TERM.findall(body)
    shape = re.sub(r"\b(?=\w*\d)\w+\b", "#", plain(body))
    return [zlib.crc32(w.encode()) - 2**31 for w in set(words)], len(words), hash64(shape)


def residue(passages: DataFrame, fetches: DataFrame, sources: DataFrame, few_terms: int = 25, low_share: float = 0.25, copies: int = 3) -> DataFrame:
    """``(passage_id)`` of each passage with residue standing for content.

    A passage is named if a detector finds residue in it, or if its document
    shares no term with the slug of its address and its title (of two terms or
    more), is of low information (``few_terms`` distinct terms at most, or of 40
    words or more under ``low_share`` distinct), and its text, figures aside,
    answers ``copies`` addresses or two of one host; a bad HTTP status or an
    error noted by the fetch stands for one copy.  Repeated rows count once;
    null and empty texts have no residue; documents without a fetch are judged
    by detectors alone.
    """
    scratch = Scratch(passages.sparkSession, "residue")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [content_lines(t) for t in batch.column(2).to_pylist()]
            found = [_terms(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([has_residue(t) for t in texts]), pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()),
                ],
                names=["passage_id", "document_id", "flag", "terms", "words", "shape"],
            )

    some = passages.where("text is not null and text != ''").select(F.col("passage_id").cast("long"), F.col("document_id").cast("long"), "text")
    read = spread(some).mapInArrow(run, "passage_id long, document_id long, flag boolean, terms array<int>, words int, shape long")
    read = scratch.save(read.dropDuplicates(["passage_id"]))
    direct = read.where("flag").select("passage_id")

    bad = (F.coalesce(F.col("http_status"), F.lit(200)) >= 400) | (F.coalesce(F.col("error"), F.lit("")) != "")
    page = fetches.where("document_id is not null").select("document_id", "source_id", "url", "final_url", "title", "http_status", "error").join(sources.select("source_id", F.col("url").alias("source_url")), "source_id", "left")
    page = page.groupBy("document_id").agg(
        F.max(F.coalesce("final_url", "url")).alias("url"), F.max(F.coalesce("title", F.lit(""))).alias("title"), F.max(bad).alias("bad"), F.max("source_url").alias("source_url")
    )
    slug = F.regexp_replace(F.col("url"), r"^[a-zA-Z]+://[^/]*|[?#].*$", " ")
    known = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", slug, "title")), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))
    page = page.select("document_id", "bad", host_of(F.coalesce("source_url", "url")).alias("host"), F.transform(known, lambda w: (F.crc32(w) - F.lit(2**31)).cast("int")).alias("known"))
    # every document is compared; a document is its passages taken together, in any order
    met = read.join(page, "document_id").select("document_id", "bad", "host", "shape", "words", F.size("terms").alias("n"), (F.size("known") >= 2).alias("named"), F.arrays_overlap("terms", "known").alias("fits"))
    whole = met.groupBy("document_id").agg(
        F.bool_or("fits").alias("fits"), F.first("named").alias("named"), F.first("bad").alias("bad"), F.first("host").alias("host"), F.bit_xor("shape").alias("shape"), F.sum("n").alias("n"), F.sum("words").alias("words")
    )
    poor = (F.col("n") <= few_terms) | ((F.col("words") >= 40) & (F.col("n") < low_share * F.col("words")))
    misfit = scratch.save(whole.where(F.col("named") & ~F.col("fits") & (F.col("n") >= 2) & poor).select("document_id", "bad", "host", "shape"))
    everywhere = misfit.groupBy("shape").agg(F.count("*").alias("n_all"))
    by_host = misfit.groupBy("shape", "host").agg(F.count("*").alias("n_host"))
    judged = misfit.join(everywhere, "shape").join(by_host, ["shape", "host"], "left")
    canned = judged.where((F.col("n_all") + F.col("bad").cast("int") >= copies) | (F.col("n_host") >= 2)).select("document_id")
    named = read.where(F.size("terms") > 0).join(canned, "document_id", "left_semi").select("passage_id")
    return direct.union(named).distinct()


def without_residue(passages: DataFrame, named: DataFrame) -> DataFrame:
    """``passages`` without those of ``named``."""
    return passages.join(named.select("passage_id"), "passage_id", "left_anti")
