"""Test material inside corpus documents, by Wu-Manber search over words.

The test items' passages and questions are cut into patterns of ``M`` words.
A shift table over blocks of two words lets a cursor jump over stretches that
cannot end a pattern, the block at the end of a window picks a bucket of
patterns, and those are compared word by word.  Cursors of many documents move
in lockstep.  Every confirmed pattern is then extended along its diagonal,
over misspelt words too, and runs of ``min_words`` words of the item are leaks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import Scratch, spread

M = 4  # words of a pattern
SEGMENT = 192  # words a cursor runs over
PIECE = 256  # spaced words of an item searched as one
PLACES = 200_000  # places of patterns extended at once
CELLS = 4_000_000  # words compared at once
WORD = re.compile(r"[^\W_]+")


def words_of(line: str) -> tuple[list[str], list[int]]:
    """Letters-and-digits words in lower case, and the number of each one's spaced word."""
    out, at = [], []
    for n, w in enumerate(line.split()):
        for x in WORD.findall(re.sub("['’]", "", w.lower())):
            out.append(x)
            at.append(n)
    return out, at


@lru_cache(1 << 18)
def close(a: str, b: str) -> bool:
    """Equal, or one misspelt: an edit or two, figures excepted."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 2 or min(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    most = 1 if min(len(a), len(b)) < 5 else 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    if row[-1] <= most:
        return True
    return sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) <= 2  # two letters swapped


def pieces_of(line: str, need: int) -> list[tuple[list[str], list[int]]]:
    """``words_of`` a line in pieces of ``PIECE`` spaced words that overlap, so that every run of ``need`` lies in one."""
    spaced = line.split()
    step = max(1, PIECE - need + 1)
    return [words_of(" ".join(spaced[i : i + PIECE])) for i in range(0, max(1, len(spaced) - need + 1), step)]


class Patterns:
    """Search tables of a bounded set of ``(item, text, need)``: ``need`` words of the text in a row are a leak."""

    def __init__(self, parts: list[tuple[int, str, int]]) -> None:
        owners: dict[tuple[str, int], set[int]] = defaultdict(set)
        for item, text, need in parts:
            owners[text, need].add(item)
        self.words, self.at, self.items, need_of = [], [], [], []
        for (text, need), ids in sorted(owners.items()):
            for w, at in pieces_of(text, need):
                if len(w) >= M:
                    self.words.append(w)
                    self.at.append(at)
                    self.items.append(sorted(ids))
                    need_of.append(need)
        self.need = np.array(need_of, "i4")
        vocabulary = sorted({x for w in self.words for x in w})
        self.vocabulary = pa.array(vocabulary, pa.string())
        number = {w: i + 1 for i, w in enumerate(vocabulary)}  # 0: any other word
        self.size = len(vocabulary) + 1
        # all pieces in one flat array: a long one costs its own length and no more
        self.length = np.array([len(w) for w in self.words], "i8")
        self.begin = np.r_[0, np.cumsum(self.length)].astype("i8")
        self.flat = np.array([number[x] for w in self.words for x in w], "i4")
        self.letters = np.array([-9 if x.isdigit() else len(x) for w in self.words for x in w], "i4")  # figures are never misspelt
        piece = np.repeat(np.arange(len(self.words)), self.length)
        at = np.arange(len(self.flat)) - self.begin[piece]
        starts = np.flatnonzero(at <= self.length[piece] - M) if len(piece) else np.zeros(0, "i8")
        grams = self.flat[starts[:, None] + np.arange(M)].astype("i8").reshape(-1, M)
        # every pattern is a seed, however many items share it: of a run with misspelt words any one may be the last whole one
        self.pattern, which = np.unique(grams, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        self.place_line, self.place_at = piece[starts[order]], at[starts[order]]
        self.place_first = np.searchsorted(which.ravel()[order], np.arange(len(self.pattern) + 1)).astype("i8")
        self.bits = 20
        blocks = self.hash(self.pattern[:, :-1], self.pattern[:, 1:])
        self.shift = np.full(1 << self.bits, M - 1, "i1")
        for q in range(M - 1):  # a block that ends q words before the pattern's end
            np.minimum.at(self.shift, blocks[:, M - 2 - q], q)
        last = blocks[:, -1]
        self.by_suffix = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.by_suffix], np.arange((1 << self.bits) + 1))

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * self.size + b) * 0x9E3779B1 >> 7) & ((1 << self.bits) - 1)

    def number(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Word numbers of all texts in a row, the offset of each text, the words' lengths, and the words."""
        low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), "['’]", "")
        spaced = pc.utf8_trim(pc.replace_substring_regex(low, r"[^\pL\pN]+", " "), " ")
        split = pc.split_pattern(spaced, " ")
        values = pc.list_flatten(split)
        coded = values.dictionary_encode()
        own = pc.fill_null(pc.add(pc.index_in(coded.dictionary, self.vocabulary), 1), 0).to_numpy(zero_copy_only=False).astype("i8")
        offsets = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype("i8"))]
        which = coded.indices.to_numpy(zero_copy_only=False)
        letters = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
        return own[which], offsets, letters[which], values

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a pattern ends, and its number."""
        n = len(ids)
        ends, which = [], []
        if n < M or not len(self.pattern):
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        cursor = np.arange(0, n, SEGMENT) + M - 1
        stop = np.minimum(cursor + SEGMENT, n)
        while True:
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
            if not len(cursor):
                break
            block = self.hash(ids[cursor - 1], ids[cursor])
            shift = self.shift[block]
            at = np.flatnonzero(shift == 0)
            if len(at):
                count = self.first[block[at] + 1] - self.first[block[at]]
                end = np.repeat(cursor[at], count)
                slot = np.repeat(self.first[block[at]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                pattern = self.by_suffix[slot]
                same = np.ones(len(end), bool)
                for k in range(M):
                    same &= ids[end - M + 1 + k] == self.pattern[pattern, k]
                ends.append(end[same])
                which.append(pattern[same])
            cursor = cursor + np.maximum(shift, 1)
        return (np.concatenate(ends), np.concatenate(which)) if ends else (np.zeros(0, "i8"), np.zeros(0, "i8"))

    def leaks(self, texts: pa.Array) -> set[tuple[int, int]]:
        """(number of the text, test item) for each text that holds a run of an item."""
        ids, offsets, letters, values = self.number(texts)
        ends, which = self.search(ids)
        order = np.argsort(ends, kind="stable")
        ends, which = ends[order], which[order]
        count = self.place_first[which + 1] - self.place_first[which]
        found: set[tuple[int, int]] = set()
        # a pattern shared by many items has many places: they are laid out in bounded parts
        part = np.cumsum(count) // PLACES
        for at in np.split(np.arange(len(ends)), np.flatnonzero(np.diff(part)) + 1):
            self._extend(ids, offsets, letters, values, ends[at], which[at], count[at], found)
        return found

    def _extend(self, ids: np.ndarray, offsets: np.ndarray, letters: np.ndarray, values: pa.Array, ends: np.ndarray, which: np.ndarray, count: np.ndarray, found: set[tuple[int, int]]) -> None:
        """Add to ``found`` what the confirmed patterns' diagonals hold."""
        slot = np.repeat(self.place_first[which], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(ends - M + 1, count) - self.place_at[slot]  # where the piece's first word would stand
        pairs = np.stack([start, self.place_line[slot], np.repeat(ends, count)], 1)
        doc = np.searchsorted(offsets, pairs[:, 2], side="right") - 1
        _, one = np.unique(np.stack([start, pairs[:, 1], doc], 1), axis=0, return_index=True)
        pairs, doc = pairs[one], doc[one]
        order = np.argsort(self.length[pairs[:, 1]], kind="stable")
        pairs, doc = pairs[order], doc[order]
        begin = 0
        while begin < len(pairs):
            longest = self.length[pairs[begin, 1]]
            end = begin + max(1, int(CELLS // longest))
            end = min(end, begin + int(np.searchsorted(self.length[pairs[begin:, 1]], 2 * longest, side="right")))
            self._compare(ids, offsets, letters, values, pairs[begin:end], doc[begin:end], found)
            begin = end

    def _compare(self, ids: np.ndarray, offsets: np.ndarray, letters: np.ndarray, values: pa.Array, pairs: np.ndarray, doc: np.ndarray, found: set[tuple[int, int]]) -> None:
        piece = pairs[:, 1]
        k = np.arange(self.length[piece].max())
        at = pairs[:, :1] + k
        inside = (at >= offsets[doc][:, None]) & (at < offsets[doc + 1][:, None]) & (k < self.length[piece][:, None])
        own = np.minimum(self.begin[piece][:, None] + k, len(self.flat) - 1)
        at = np.clip(at, 0, len(ids) - 1)
        equal = (ids[at] == self.flat[own]) & inside
        sums = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1, dtype="i4")
        need = self.need[piece]
        for n in np.unique(need):
            # a run with a misspelt word here and there: two thirds of some stretch are equal
            wide = min(int(n), len(k))
            rows = np.flatnonzero(need == n)
            most = (sums[rows, wide:] - sums[rows, :-wide]).max(1)
            rows = rows[most * 3 >= 2 * n]
            # words of about the same length may be misspelt ones
            maybe = equal[rows] | (inside[rows] & (np.abs(letters[at[rows]] - self.letters[own[rows]]) <= 2))
            run = (k - np.maximum.accumulate(np.where(maybe, -1, k), axis=1)).max(1)
            for r, may in zip(rows[run >= wide], maybe[run >= wide]):
                p, text = int(piece[r]), int(doc[r])
                if all((text, x) in found for x in self.items[p]):
                    continue
                here = np.flatnonzero(inside[r])
                lo, hi = here[0], here[-1] + 1
                if self._longest(equal[r, lo:hi], may[lo:hi], values, int(pairs[r, 0] + lo), self.words[p][lo:hi], self.at[p][lo:hi], int(n)):
                    found.update((text, x) for x in self.items[p])

    @staticmethod
    def _longest(equal: np.ndarray, maybe: np.ndarray, values: pa.Array, start: int, words: list[str], at: list[int], need: int) -> bool:
        first = None
        for k, same in enumerate(equal):
            if same or maybe[k] and close(values[start + k].as_py(), words[k]):
                first = k if first is None else first
                if at[k] - at[first] + 1 >= need:
                    return True
            else:
                first = None
        return False


def item_parts(items: DataFrame, min_words: int, stock_passages: int) -> DataFrame:
    """``(item_id, text, need)``: what of each test item is searched, and how many words in a row are a leak.

    The last line is the question, the lines before it are the passage, but
    for stock instructions: lines that stand above at least ``stock_passages``
    different passages.  Where the passage and the question are both shorter
    than ``min_words``, the whole item counts: ``min_words`` of its words in a
    row, or all of them if there are fewer.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").distinct().select("item_id", F.xxhash64("text").alias("t"), lines.alias("l")).where(F.size("l") > 0)
    n = F.size("l")
    above = rows.where(n > 2).select(F.element_at("l", -2).alias("passage"), F.explode(F.slice("l", 1, F.greatest(n - 2, F.lit(0)))).alias("line"))
    stock = above.select("line", F.xxhash64("passage").alias("p")).distinct().groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= stock_passages).select("line", F.lit(True).alias("stock"))
    each = rows.select("item_id", "t", n.alias("n"), F.posexplode("l").alias("i", "line")).join(stock, "line", "left")
    each = each.where((F.col("i") >= F.col("n") - 2) | F.col("stock").isNull())
    ordered = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("i", "line")))), lambda x: x["line"]), " ")
    last = F.col("i") == F.col("n") - 1
    whole = each.groupBy("item_id", "t").agg(ordered(~last).alias("passage"), ordered(last).alias("question"))  # within one item: bounded
    count = lambda c: F.size(F.filter(F.split(c, " "), lambda x: x != ""))
    both = F.concat_ws(" ", "passage", "question")
    short = (count("passage") < min_words) & (count("question") < min_words)
    parts = F.when(short, F.array(both)).otherwise(F.array("passage", "question"))
    part = whole.select("item_id", short.alias("short"), F.explode(parts).alias("text"))
    words = count("text")
    part = part.where((words >= min_words) | (F.col("short") & (words > 0)))
    return part.select("item_id", "text", words.alias("words"), F.least(words, F.lit(min_words)).alias("need"))


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = 15, block_words: int = 1_000_000, stock_passages: int = 5) -> DataFrame:
    """``(doc_id, item_id)``: the document holds ``min_words`` words of the item in a row.

    Words are compared without case, punctuation and spacing, and a misspelt
    word here and there does not end a run.  What of an item is searched, and
    what counts for short items, ``item_parts`` says.  Null or empty texts and
    items hold nothing, nor do items of under ``M`` words.  Documents with an
    equal id are told apart by nothing: their leaks are united.  Items are the
    stated query set: they go to all tasks in blocks of about ``block_words``
    words (some 100 MB of tables), however many there are.
    """
    spark = documents.sparkSession
    parts = Scratch(spark, "items").save(item_parts(items, min_words, stock_passages))
    total = parts.agg(F.sum(F.col("words") + F.lit(min_words))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    texts = spread(documents.where("text is not null").select(F.col("doc_id").cast("long"), "text"))
    out = None
    for b in range(blocks):
        part = parts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else parts
        shared = spark.sparkContext.broadcast(Patterns([(r.item_id, r.text, r.need) for r in part.collect()]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables = shared.value
            for batch in batches:
                for i in range(0, len(batch), 2_000):
                    some = batch.slice(i, 2_000)
                    found = sorted(tables.leaks(some.column(1)))
                    ids = some.column(0).take(pa.array([d for d, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([n for _, n in found], pa.int64())], names=["doc_id", "item_id"])

        found = texts.mapInArrow(run, "doc_id long, item_id long")
        out = found if out is None else out.union(found)
    return out.distinct()
