"""Lines that come back in many documents of one site.

First pass: every task sketches its lines, one count-min row of bounded width
a site, and only the sketches travel; merged by sums they never count too low,
and say which lines of a site can be frequent at all.  Second pass: exact
distinct document counts of those candidates only.  The confirmed lines are
then looked up per occurrence, by a broadcast set while that set is small and
by a salted join beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.session import Scratch, spread

# Month names of the languages the pages come in.
MONTHS = """
january february march april may june july august september october november december
januar februar märz mai juni juli oktober dezember
janvier février mars avril juin juillet août septembre octobre novembre décembre
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
""".split()
# Short forms count as months only between figures.
SHORT_MONTHS = "jan feb mar apr jun jul aug sep sept oct nov dec okt dez mrz janv févr avr juil déc ene abr ago dic".split()

SKETCH = "s long, places binary, counts binary"


def host_of(url: Column) -> Column:
    """Host of a URL in lower case without ``www.`` and port; null if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def line_key(line: Column) -> Column:
    """What is left of a line without case, spacing, punctuation, figures and months.

    Empty for a line without any other letter.
    """
    short = "|".join(SHORT_MONTHS)
    x = F.lower(line)
    beside = F.regexp_replace(x, rf"(\d[.,]? ?)\b(?:{short})\b(\.?[ .,]*\d)", "$1 $2")
    words = F.split(F.when(x.rlike(rf"\d[.,]? ?(?:{short})\b"), beside).otherwise(x), r"[^\p{L}\p{M}]+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(MONTHS)), "")


def document_sites(fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """``(document_id, site)``, one row a document; null hosts are left out."""
    doc = fetches.where("document_id is not null").groupBy("document_id").agg(F.min("source_id").alias("source_id"))
    host = sources.select("source_id", host_of(F.col("url")).alias("site")).where("site is not null")
    host = host.groupBy("source_id").agg(F.min("site").alias("site"))
    return doc.join(host, "source_id").select("document_id", "site")


def _summed(s: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counters ``at`` of the sites ``s``, one entry each in order of site and place, with their counts summed up."""
    order = np.lexsort((at, s))
    s, at, n = s[order], at[order], n[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (at[1:] != at[:-1])])
    return s[first], at[first], np.add.reduceat(n, first)


def _packed(s: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """Ordered entries as rows of a site each: the places of its counters in use and their counts (saturating at 255) as bytes."""
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    ends = np.r_[starts, len(s)].astype("i4")
    places = at.astype(_place(width))

    def column(data: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends * data.itemsize), pa.py_buffer(data)])

    return pa.RecordBatch.from_arrays([pa.array(s[starts]), column(places), column(np.minimum(n, 255).astype("u1"))], names=["s", "places", "counts"])


def _place(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


def _entries(batch: pa.RecordBatch, width: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of rows of ``_packed``, about ``most`` at a time."""

    def column(i: int) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(i).cast(pa.binary())
        ends = np.frombuffer(x.buffers()[1], "i4", len(x) + 1, 4 * x.offset)
        return ends, np.frombuffer(x.buffers()[2] or b"", "u1")

    if not len(batch):
        return
    s = batch.column(0).to_numpy(zero_copy_only=False)
    (place_ends, places), (ends, counts) = column(1), column(2)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        here = places[place_ends[at] : place_ends[to]].view(_place(width))
        yield np.repeat(s[at:to], np.diff(ends[at : to + 1])), here.astype("i8"), counts[ends[at] : ends[to]].astype("i8")
        at = to


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of whole sites, summed up, from rows in order of site; held are one site's counters and one block of entries."""
    held = None
    for batch in batches:
        for block in _entries(batch, width):
            s, at, n = _summed(*(np.concatenate(x) for x in zip(held, block))) if held else _summed(*block)
            whole = int(np.searchsorted(s, s[-1]))  # the last site may go on
            if whole:
                yield s[:whole], at[:whole], n[:whole]
            held = s[whole:], at[whole:], n[whole:]
    if held:
        yield held


def site_sketches(lines: DataFrame, width: int, flush: int = 1_000_000) -> DataFrame:
    """``(s, places, counts)``: per task and site the counters of its lines' hashes ``h``; a task holds ``flush`` lines at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            s, b = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return _packed(*_summed(s, b, np.ones(len(s), "i8")), width)

        n = 0
        for batch in batches:
            s, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            held.append((s, h % width))
            n += len(s)
            if n >= flush:
                yield emit()
                n = 0
        if held and n:
            yield emit()

    return lines.select("s", "h").mapInArrow(run, SKETCH)


def frequent_buckets(sketches: DataFrame, width: int, least: int, salts: int, large: int = 1 << 12) -> DataFrame:
    """``(s, b)``: the counters of each site that reach ``least`` in the sum of its sketches.

    They are merged in two steps, sites one after the other; in the first one
    the sketches of ``large`` counters or more are dealt out over the salts.
    """

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _merged(batches, width):
            yield _packed(*entries, width)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, at, n in _merged(batches, width):
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(at[keep].astype("i4"))], names=["s", "b"])

    salt = F.when(F.octet_length("counts") >= large, F.pmod(F.xxhash64("counts"), F.lit(salts))).otherwise(0)
    part = sketches.withColumn("salt", salt).repartition("s", "salt").sortWithinPartitions("s").select("s", "places", "counts").mapInArrow(some, SKETCH)
    return part.repartition("s").sortWithinPartitions("s").mapInArrow(last, "s long, b int")


def repeated_lines(
    passages: DataFrame,
    fetches: DataFrame,
    sources: DataFrame,
    min_documents: int = 6,
    width: int = 1 << 16,
    broadcast_bytes: int = 8 << 20,
    salts: int = 32,
) -> DataFrame:
    """``(passage_id, line_no)`` of each line found in ``min_documents`` documents of its site.

    Lines count as the same if ``line_key`` is the same; lines without a letter
    are left out.  ``line_no`` counts from 0 over the text split at ``\\n``.
    Repeated rows of a passage count once; null texts and documents without a
    known host give nothing.  ``width`` is the number of counters of a site's
    summary: a wider one spares work in the second pass, any width gives the
    same result (``min_documents`` of 255 at most).
    """
    scratch = Scratch(passages.sparkSession, "lines")
    keys = F.transform(F.split("text", "\n"), line_key)
    hashed = F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"))))
    rows = spread(passages.where("text is not null").select("passage_id", "document_id", "text")).select("passage_id", "document_id", hashed.alias("keys"))
    # only hashes travel to meet their site, never the texts
    rows = rows.join(document_sites(fetches, sources), "document_id")
    lines = rows.select("passage_id", "document_id", "site", F.posexplode("keys").alias("line_no", "k")).where("k is not null")
    lines = scratch.save(lines.select("passage_id", "document_id", "line_no", F.xxhash64("site").alias("s"), "k.h", "k.g"))

    summary = scratch.save(frequent_buckets(site_sketches(lines, width), width, min(min_documents, 255), salts))
    candidates = lines.withColumn("b", F.pmod("h", F.lit(width)).cast("int"))
    candidates = scratch.save(_held(candidates, summary, ["s", "b"], broadcast_bytes, salts).drop("b"))
    scratch.drop(lines, summary)

    documents = candidates.select("s", "h", "g", "document_id").distinct()
    confirmed = documents.groupBy("s", "h", "g").agg(F.count("*").alias("n")).where(F.col("n") >= min_documents)
    confirmed = scratch.save(confirmed.select("s", "h", "g"))
    found = _held(candidates, confirmed, ["s", "h", "g"], broadcast_bytes, salts)
    return found.select("passage_id", "line_no").distinct()


def _held(rows: DataFrame, table: DataFrame, keys: list[str], broadcast_bytes: int, salts: int) -> DataFrame:
    """The rows whose keys a saved table of distinct keys has; a key of a third of all rows is spread over the salts.

    What counts is the table's size as a hash table in memory, many times that
    of its files: a row of keys twice, their lengths and links, four slots.
    """
    if table.count() * (16 * (1 + len(keys)) + 80) <= broadcast_bytes:
        return rows.join(F.broadcast(table), keys, "left_semi")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Spark knows the small files only, not the rows that the salts make of them
    salted = salted.hint("merge")
    return rows.withColumn("salt", F.pmod("passage_id", F.lit(salts)).cast("int")).join(salted, [*keys, "salt"], "left_semi").drop("salt")


def without_lines(passages: DataFrame, found: DataFrame) -> DataFrame:
    """``passages`` with the lines of ``found`` taken out of ``text``.

    Blank lines left at the ends or doubled by the removal are dropped; a
    passage of which nothing is left has an empty text.
    """
    gone = found.groupBy("passage_id").agg(F.collect_set("line_no").alias("_gone_lines"))  # within one passage: bounded
    parts = F.split("text", "\n")
    kept = F.filter(parts, lambda x, i: ~F.coalesce(F.array_contains("_gone_lines", i), F.lit(False)))
    text = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    joined = passages.join(gone, "passage_id", "left")
    return joined.withColumn("text", F.when(F.col("_gone_lines").isNull(), F.col("text")).otherwise(text)).drop("_gone_lines")
