"""Token ids of a byte-level BPE vocabulary, by batched numpy merge rounds.

A batch's distinct words lie in one flat array of symbols, cut where two bytes
stand side by side in no token, for no merge can ever join them.  Each round
looks every neighbouring pair up by binary search over the sorted pair keys and
merges, part by part, the pair of the lowest rank wherever it stands; parts
without a pair leave.  Words of any length go the same way; batches are bounded
by bytes.  Words already met come from a bounded cache.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from attestor.session import spread

# The splitting pattern that belongs to the vocabulary, and what
# it comes to on ASCII text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BYTES = 4_000_000  # bytes of words merged at once (a longer word goes alone)
CACHE = 64_000_000  # bytes of words remembered by a task


class Merges:
    """Pair keys (left id * size + right id), sorted, and the id each pair merges to."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], "i8")
        self.joined = np.zeros((256, 256), bool)  # two bytes that stand side by side in some token
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                self.joined[token[i - 1], token[i]] = True
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        keys = np.fromiter(pairs.keys(), "i8", len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.fromiter(pairs.values(), "i8", len(pairs))[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank (which is the merged id) of each pair; ``size`` where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.size)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, in batches of about ``BYTES``."""
        out: list[list[int]] = []
        ends = np.cumsum([len(w) for w in words])
        first = 0
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BYTES, side="right")))
            out += self._merge(words[first:last])
            first = last
        return out

    def _merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, all words together round by round."""
        raw = np.frombuffer(b"".join(words), "u1")
        if not len(raw):
            return [[] for _ in words]
        lengths = np.array([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), lengths)
        part = np.cumsum(np.r_[False, (word[1:] != word[:-1]) | ~self.joined[raw[:-1], raw[1:]]])
        symbols, place = self.byte[raw], np.arange(len(raw))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), self.size)
            inside = part[:-1] == part[1:]
            rank[:-1][inside] = self.look_up(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            open_ = best < self.size
            if not open_.all():
                keep = np.repeat(open_, counts)
                done.append((place[~keep], symbols[~keep]))
                symbols, part, place, rank = symbols[keep], part[keep], place[keep], rank[keep]
                best, counts = best[open_], counts[open_]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, counts)
            # of a run of overlapping hits (aaa) every second one merges
            first = hit & ~np.r_[False, hit[:-1]]
            run = np.arange(len(hit)) - np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit &= run % 2 == 0
            symbols[hit] = rank[hit]
            keep = ~np.r_[False, hit[:-1]]
            symbols, part, place = symbols[keep], part[keep], place[keep]
        at, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(at)
        flat = ids[order].tolist()
        ends = np.cumsum(np.bincount(word[at], minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(<id_col>, ids)``: the token ids of each row's whole text, no special tokens.

    Null and empty texts have the empty list.  One row out for each row in;
    the strings of special tokens are ordinary text.  The vocabulary (a file of
    the driver, 50k entries: a fixed size) is broadcast.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = shared.value
        ascii_words, words = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
        known: dict[str, list[int]] = {}
        held = 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start = 0
            while start < len(texts):  # slices of a few million characters
                end, size, split = start, 0, []
                while end < len(texts) and size < 4_000_000:
                    t = texts[end].as_py() or ""
                    size += len(t)
                    split.append(ascii_words(t) if t.isascii() else words(t))
                    end += 1
                if held > CACHE:
                    known.clear()
                    held = 0
                new = list(set(chain.from_iterable(split)).difference(known))
                raw = [w.encode("utf-8", "replace") for w in new]
                held += sum(map(len, raw))
                known.update(zip(new, merges.encode_words(raw)))
                rows = [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
                offsets = np.cumsum([0, *map(len, rows)], dtype="i4")
                flat = np.fromiter(chain.from_iterable(rows), "i4", offsets[-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "ids"]
                )
                start = end

    kind = documents.schema[id_col].dataType.simpleString()
    return spread(documents.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
