"""Embedding texts: an embedder interface, a deterministic one, and the cache-aware pass."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    model: str
    dim: int

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Words hashed to dimensions, unit length: a deterministic stand-in for a model."""

    def __init__(self, dim: int = 96, model: str = "hashing-v1") -> None:
        self.dim, self.model = dim, model

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), "f4")
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                out[i, zlib.crc32(w.encode()) % self.dim] += 1
            if not out[i].any():
                out[i, -1] = 1
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).tolist()


def embed_missing(rows: DataFrame, id_col: str, cache: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """``(id, text_sha256, embedding)`` for every row with a text: cached vectors, else embedded once a text.

    ``cache`` has ``(model, text_sha256, embedding)``; only texts it lacks reach
    the embedder, each distinct one once, in batches.  A vector of another
    size than the embedder's is an error.
    """
    t = rows.where("text is not null").select(id_col, "text", F.sha2("text", 256).alias("text_sha256"))
    have = cache.where(F.col("model") == embedder.model).select("text_sha256", "embedding").dropDuplicates(["text_sha256"])
    miss = t.select("text_sha256", "text").dropDuplicates(["text_sha256"]).join(have.select("text_sha256"), "text_sha256", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), batch):
                some = b.slice(i, batch)
                v = embedder.embed_documents(some.column(1).to_pylist())
                if len(v) != len(some) or any(len(x) != embedder.dim for x in v):
                    raise ValueError("the embedder gave other vectors than asked for")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(v, pa.list_(pa.float32()))], names=["text_sha256", "embedding"])

    made = miss.mapInArrow(run, "text_sha256 string, embedding array<float>")
    return t.join(have.union(made), "text_sha256").select(id_col, "text_sha256", "embedding")
