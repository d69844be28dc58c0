"""Join operators: spans, neighbours, equal keys, Hamming bands, exact nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.text import hamming
from attestor.operators.ranking import cap_per


def point_in_span(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, order: str, cell: int = 2_000) -> DataFrame:
    """Each point with the first span of its keys that holds it, or nulls.

    Spans are half-open and laid out in the cells of ``cell`` places that they
    touch, so a key with very many points and spans meets cell by cell.  A
    point without a place or a key keeps its row; empty spans hold nothing.
    """
    names = list(dict.fromkeys((start, end, order, *[c for c in spans.columns if c not in keys])))
    span = spans.where(F.col(end) > F.col(start)).select(*keys, *[F.col(c).alias(f"span_{c}") for c in names])
    number = lambda c: F.floor(c / cell).cast("long")
    span = span.withColumn("_cell", F.explode(F.sequence(number(F.col(f"span_{start}")), number(F.col(f"span_{end}") - 1))))
    place = points.where(F.col(at).isNotNull()).select(*keys, at).distinct().withColumn("_cell", number(F.col(at)))
    inside = place.join(span, [*keys, "_cell"]).where((F.col(at) >= F.col(f"span_{start}")) & (F.col(at) < F.col(f"span_{end}")))
    hit = inside.groupBy(*keys, at).agg(F.min(F.struct(F.col(f"span_{order}").alias("o"), *[F.col(f"span_{c}") for c in names])).alias("_hit"))
    return points.join(hit, [*keys, at], "left").select(*points.columns, *[F.col(f"_hit.span_{c}") for c in names])


def neighbours(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """``before`` and ``after``: the values of up to ``n`` rows on either side, in order."""
    n = max(0, min(5, n))
    w = Window.partitionBy(*keys).orderBy(order)
    empty = F.array().cast("array<string>")
    before = F.collect_list(F.col(value).cast("string")).over(w.rowsBetween(-n, -1)) if n else empty
    after = F.collect_list(F.col(value).cast("string")).over(w.rowsBetween(1, n)) if n else empty
    return df.withColumn("before", before).withColumn("after", after)


def hash_pairs(df: DataFrame, id_col: str, hash_col: str, most: int = 3) -> DataFrame:
    """Pairs ``(a, b, distance)``, a < b, of ids whose 64-bit hashes differ in few bits.

    The hash is cut into ``most`` + 3 blocks.  Hashes at most ``most`` bits
    apart have three equal blocks, and every choice of three is a key of about
    32 bits, so that far hashes seldom meet; a pair comes out under its first
    key alone.  Equal hashes meet through one representative (the smallest id):
    copies come out as pairs with it, never as all pairs of the group.  Null
    hashes take no part.
    """
    rows = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"))
    one = rows.groupBy("h").agg(F.min("id").alias("id"))
    copies = rows.join(one.withColumnRenamed("id", "a"), "h").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    count = most + 3
    edges = [64 * i // count for i in range(count + 1)]
    masks = [((1 << hi) - (1 << lo)) - (1 << 64 if hi == 64 else 0) for lo, hi in zip(edges, edges[1:])]
    choices = list(combinations(range(count), 3))
    keys = F.array(*[F.col("h").bitwiseAND(F.lit(masks[i] | masks[j] | masks[k]).cast("long")) for i, j, k in choices])
    bands = one.select("id", "h", F.posexplode(keys).alias("band", "key"))
    right = bands.select(F.col("id").alias("b"), F.col("h").alias("h2"), "band", "key")
    differ = F.col("h").bitwiseXOR(F.col("h2"))
    equal = F.filter(F.array(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)]), lambda x: x.isNotNull())
    names = F.array(*[F.array(*map(F.lit, c)) for c in choices])
    near = (
        bands.join(right, ["band", "key"])
        .where((F.col("id") < F.col("b")) & (hamming(F.col("h"), F.col("h2")) <= most))
        .where(F.slice(equal, 1, 3) == F.element_at(names, F.col("band") + 1))
        .select(F.col("id").alias("a"), "b", hamming(F.col("h"), F.col("h2")).alias("distance"))
    )
    return near.union(copies)


def cosine_to(vector: Column, wanted: list[float]) -> Column:
    """Cosine similarity to one vector; null for null, zero or other-length vectors."""
    q = np.asarray(wanted, "f8")
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def sim(v: pd.Series) -> pd.Series:
        out = np.full(len(v), np.nan)
        ok = np.array([x is not None and len(x) == len(q) for x in v])
        if ok.any():
            x = np.stack(v[ok].to_list()).astype("f8")
            n = np.linalg.norm(x, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[ok] = (x @ q) / n
        return pd.Series([None if np.isnan(s) else s for s in out], dtype="Float64")

    return sim(vector)


def nearest_of_some(rows: DataFrame, queries: DataFrame, k: int, block: int = 4_000) -> DataFrame:
    """``(query_id, id, similarity)``: exactly the ``k`` nearest rows of each query.

    Both sides have ``(id, model, v)``; only equal models of equal length meet,
    and a row is not its own neighbour.  Queries are a stated set: they go to
    the tasks in blocks of ``block``, each task keeps its best ``k`` a query,
    and the lists are merged.  Equal similarity (to 9 places): smaller id first.
    """
    spark = rows.sparkSession
    count = queries.count()
    blocks = max(1, -(-count // block))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) if blocks > 1 else queries
        some = part.toPandas()
        sides = {}
        for model, g in some.groupby("model"):
            x = np.stack(g["v"].to_list()).astype("f8")
            sides[model] = (g["id"].to_numpy(), x / np.linalg.norm(x, axis=1, keepdims=True))
        shared = spark.sparkContext.broadcast(sides)

        def near(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for model, g in batch.groupby("model"):
                    if model not in shared.value:
                        continue
                    qid, q = shared.value[model]
                    ids = g["id"].to_numpy()
                    x = np.stack(g["v"].to_list()).astype("f8")
                    s = (q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T).round(9)
                    s[qid[:, None] == ids[None, :]] = -2
                    take = min(k, s.shape[1])
                    floor = np.partition(s, -take, axis=1)[:, -take][:, None]
                    r, c = np.nonzero((s >= floor) & (s > -2))
                    yield pd.DataFrame({"query_id": qid[r], "id": ids[c], "similarity": s[r, c]})

        found = rows.select("id", "model", "v").mapInPandas(near, "query_id long, id long, similarity double")
        out = found if out is None else out.union(found)
    return cap_per(out, ["query_id"], [F.desc("similarity"), F.col("id")], k)
