"""The most similar vectors of every vector, by learned partitions.

1. A bounded sample of the vectors of each model gives a neighbour graph, and
   that graph is cut into balanced partitions, each model in a task of its own.
2. A small softmax classifier learns to tell a vector's partition from its
   neighbours' partitions.
3. Every vector is indexed under its most probable partition and asked for in
   its most probable ones; what a question finds counts for both of its ends.
   Blocks of questions meet blocks of the index in numpy, and the exact
   similarities are ranked.

Only the sample and the classifier are bounded; every row is indexed and every
row is a query.  Equal vectors are indexed once, with the ids that can matter.
Vectors travel as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.operators.joins import nearest_of_some
from attestor.session import Scratch, spread


@dataclass(frozen=True)
class NeighbourOptions:
    """``sample`` bounds the rows per model that the partitions are learned from (16 a partition beyond 1,000 partitions)."""

    dim: int = 96
    neighbours: int = 5
    min_similarity: float = 0.75
    sample: int = 16_000
    partition_rows: int = 2_000
    max_partitions: int = 1_000
    probes: int = 6
    block: int = 2_000
    seed: int = 7

    def partitions(self, n: int) -> int:
        """Partitions of ``n`` rows: one for ``partition_rows``, beyond ``max_partitions`` the square root of ``n`` at least."""
        return max(1, min(round(n / self.partition_rows), max(self.max_partitions, ceil(sqrt(n)))))

    def asked(self, parts: int) -> int:
        """Partitions that a vector is asked for in: ``probes``, more where there are more partitions."""
        return min(parts, max(self.probes, ceil(1.2 * log2(max(2, parts)))))


def usable_vectors(rows: DataFrame, opt: NeighbourOptions) -> DataFrame:
    """One row ``(claim_id, model, v)`` per claim with a usable vector, its 32-bit floats as bytes.

    Null vectors, other lengths, nulls or NaN or infinity inside, all zeros and
    null models or ids take no part.  Of several usable rows of a claim the
    latest ``embedded_at`` counts (then the vector last by its bytes).
    """
    dim = opt.dim

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3)
            batch = batch.filter(pc.equal(pc.fill_null(pc.list_value_length(v), 0), dim))
            x = pc.fill_null(batch.column(3).flatten().cast(pa.float32()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            offsets = pa.py_buffer(np.arange(0, (int(ok.sum()) + 1) * 4 * dim, 4 * dim, "i4"))
            packed = pa.Array.from_buffers(pa.binary(), int(ok.sum()), [None, offsets, pa.py_buffer(np.ascontiguousarray(x[ok]))])
            rest = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), rest.column(2), packed], names=["claim_id", "model", "at", "v"])

    some = rows.where("claim_id is not null and embed_model is not null and embedding is not null")
    some = spread(some.select(F.col("claim_id").cast("long"), F.col("embed_model").cast("string").alias("model"), F.unix_micros(F.col("embedded_at").cast("timestamp")).alias("at"), "embedding"))
    packed = some.mapInArrow(pack, "claim_id long, model string, at long, v binary")
    newest = packed.groupBy("claim_id").agg(F.max_by(F.struct("model", "v"), F.struct("at", "v")).alias("x"))
    return newest.select("claim_id", "x.model", "x.v")


def _matrix(v: list[bytes], dim: int) -> np.ndarray:
    """Vectors of bytes as rows of length one."""
    x = np.frombuffer(b"".join(v), "f4").reshape(-1, dim).astype("f8")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """Row i: the sample's k nearest to its vector i."""
    n = len(vectors)
    out = np.zeros((n, min(k, n - 1)), "i4")
    for start in range(0, n, 500):
        s = vectors[start : start + 500] @ vectors.T
        s[np.arange(len(s)), np.arange(start, start + len(s))] = -2
        out[start : start + 500] = np.argpartition(-s, min(k, n - 1) - 1, axis=1)[:, :k]
    return out


def balanced_partitions(vectors: np.ndarray, graph: np.ndarray, parts: int, seed: int, slack: float = 1.1) -> np.ndarray:
    """Cut the neighbour graph into ``parts`` of nearly equal size.

    Vertices start at the nearest of ``parts`` centres and move, best gain
    first, to the partition most of their neighbours are in, as long as it has
    room.
    """
    n = len(vectors)
    room = int(np.ceil(n / parts * slack))
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(n, parts, replace=False)]
    for _ in range(4):
        near = np.argmax(vectors @ centres.T, axis=1)
        for p in np.unique(near):
            centres[p] = vectors[near == p].mean(0)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    score = vectors @ centres.T
    own = _fill(score, room)
    for _ in range(6):
        votes = np.zeros((n, parts), "f4")
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), own[graph].ravel()), 1)
        own = _fill(votes + 0.5 * score, room)
    return own


def _fill(score: np.ndarray, room: int) -> np.ndarray:
    """Each row's best column, columns holding at most ``room`` rows."""
    n, parts = score.shape
    own = np.full(n, -1)
    left = np.full(parts, room)
    score = score.copy()
    todo = np.arange(n)
    while len(todo):
        best = np.argmax(score[todo], axis=1)
        gain = score[todo, best]
        for p in np.unique(best):
            want = todo[best == p]
            want = want[np.argsort(-gain[best == p], kind="stable")]
            own[want[: left[p]]] = p
            taken = min(left[p], len(want))
            left[p] -= taken
            if left[p] == 0:
                score[:, p] = -np.inf
        todo = todo[own[todo] < 0]
    return own


def fit_router(vectors: np.ndarray, graph: np.ndarray, own: np.ndarray, parts: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression from a vector to the partitions of its neighbours."""
    n, dim = vectors.shape
    target = np.zeros((n, parts), "f4")
    np.add.at(target, (np.arange(n), own), graph.shape[1] / 2)
    np.add.at(target, (np.repeat(np.arange(n), graph.shape[1]), own[graph].ravel()), 1)
    target /= target.sum(1, keepdims=True)
    x = (vectors * np.sqrt(dim)).astype("f4")
    w = np.zeros((dim, parts), "f4")
    for p in range(parts):
        if (own == p).any():
            w[:, p] = x[own == p].mean(0) * 0.2
    b = np.zeros(parts, "f4")
    m = [np.zeros_like(w), np.zeros_like(b)]
    s = [np.zeros_like(w), np.zeros_like(b)]
    rng = np.random.default_rng(seed)
    step = 0
    for epoch in range(8):
        rate = 0.02 / (1 + epoch)
        order = rng.permutation(n)
        for i in range(0, n, 512):
            rows = order[i : i + 512]
            z = x[rows] @ w + b
            z -= z.max(1, keepdims=True)
            q = np.exp(z)
            q /= q.sum(1, keepdims=True)
            d = (q - target[rows]) / len(rows)
            step += 1
            for j, (param, g) in enumerate(((w, x[rows].T @ d + 1e-5 * w), (b, d.sum(0)))):
                m[j] = 0.9 * m[j] + 0.1 * g
                s[j] = 0.99 * s[j] + 0.01 * g * g
                param -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.99**step)) + 1e-6)
    return (w * np.sqrt(dim)).astype("f4"), b


def learn_routers(classes: DataFrame, opt: NeighbourOptions) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Model name -> (weights, bias) of its partition classifier, each fitted in a task of its own.

    What comes back is ``dim`` numbers a partition: a twentieth of a vector for
    each ``partition_rows`` of them.
    """
    counts = classes.groupBy("model").agg(F.count("*").alias("n"))
    # a hash threshold: the same rows every run
    share = F.least(F.lit(1.0), F.greatest(F.lit(float(opt.sample)), F.lit(16.0) * F.greatest(F.lit(float(opt.max_partitions)), F.sqrt("n")) * (F.col("n") > opt.max_partitions * opt.partition_rows).cast("int")) / F.col("n"))
    some = classes.join(F.broadcast(counts), "model").where((F.xxhash64("cls", F.lit(opt.seed)) / F.lit(2.0**64) + F.lit(0.5)) <= share)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls")
        parts = min(opt.partitions(int(group["n"].iloc[0])), max(1, len(group) // 16))
        if parts == 1:
            weights, bias = np.zeros((opt.dim, 1), "f4"), np.zeros(1, "f4")
        else:
            x = _matrix(group["v"].to_list(), opt.dim).astype("f4")
            graph = neighbour_graph(x, 10)
            weights, bias = fit_router(x, graph, balanced_partitions(x, graph, parts, opt.seed), parts, opt.seed)
        return pd.DataFrame({"model": group["model"].iloc[:1], "weights": [weights.astype("f4").tobytes()], "bias": [bias.astype("f4").tobytes()]})

    fitted = some.select("model", "n", "cls", "v").groupBy("model").applyInPandas(fit, "model string, weights binary, bias binary")
    return {r.model: (np.frombuffer(r.weights, "f4").reshape(opt.dim, -1), np.frombuffer(r.bias, "f4")) for r in fitted.collect()}


def _probable(batch: pa.RecordBatch, routers: dict[str, tuple[np.ndarray, np.ndarray]], opt: NeighbourOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, part, nth)`` of a batch's rows under their most probable partitions, best first."""
    models = batch.column(1).dictionary_encode()
    own, names = models.indices.to_numpy(zero_copy_only=False), models.dictionary.to_pylist()
    x = _matrix(batch.column(2).to_pylist(), opt.dim).astype("f4")
    rows, parts, nth = [], [], []
    for i, name in enumerate(names):
        at = np.flatnonzero(own == i)
        weights, bias = routers[name]
        z = x[at] @ weights + bias
        m = opt.asked(z.shape[1])
        top = np.argpartition(-z, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, 1), axis=1), 1)
        rows.append(np.repeat(at, m))
        parts.append(top.ravel())
        nth.append(np.tile(np.arange(m), len(at)))
    return np.concatenate(rows), np.concatenate(parts).astype("i4"), np.concatenate(nth)


INDEXED, ASKED, BOTH = 0, 1, 2


def nearest_vectors(rows: DataFrame, opt: NeighbourOptions = NeighbourOptions()) -> DataFrame:
    """``(claim_id, near_id, similarity)``: up to ``neighbours`` per claim.

    Only claims of the same model with cosine similarity of at least
    ``min_similarity`` count; equal similarity: the smaller id first.  Rows
    without a usable vector take no part (see ``usable_vectors``).
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "near")
    k, dim, low = opt.neighbours, opt.dim, opt.min_similarity
    claims = scratch.save(usable_vectors(rows, opt).withColumn("cls", F.xxhash64("model", "v")).withColumn("cls2", F.md5("v")))
    # the k + 1 smallest ids of equal vectors; the window is cut before its shuffle
    w = Window.partitionBy("cls", "cls2").orderBy("claim_id")
    first = claims.select("claim_id", "cls", "cls2").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    named = first.groupBy("cls", "cls2").agg(F.array_sort(F.collect_list("claim_id")).alias("ids")).withColumn("name", F.element_at("ids", 1))
    named = scratch.save(named)
    # a class is named by its first claim, whose row has its vector
    classes = scratch.save(claims.select("claim_id", "model", "v").join(named.select(F.col("name").alias("claim_id"), "ids"), "claim_id").select(F.col("claim_id").alias("cls"), "ids", "model", "v"))
    member = scratch.save(claims.select("claim_id", "cls", "cls2").join(named.select("cls", "cls2", "name"), ["cls", "cls2"]).select("claim_id", F.col("name").alias("cls")))
    scratch.drop(claims, named)

    routers = spark.sparkContext.broadcast(learn_routers(classes, opt))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                row, part, nth = _probable(batch, routers.value, opt)
                yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(part), pa.array(nth == 0)], names=["model", "part", "first"])

    vectors = classes.select("cls", "model", "v")
    load = vectors.mapInArrow(places, "model string, part int, first boolean").groupBy("model", "part").agg(F.count_if("first").alias("n_index"), F.count("*").alias("n_query")).where("n_index > 0")
    # hot partitions are split: both sides of a meeting stay below opt.block rows or so; a row for each partition comes back
    cut = {(r.model, r.part): (-(-r.n_index // opt.block), -(-r.n_query // (4 * opt.block))) for r in load.collect()}
    number = {key: i for i, key in enumerate(sorted(cut))}
    shared = spark.sparkContext.broadcast((number, np.array([cut[key] for key in sorted(cut)], "i8").reshape(-1, 2)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes = shared.value
        for batch in batches:
            if not len(batch):
                continue
            row, part, nth = _probable(batch, routers.value, opt)
            models = batch.column(1).to_pylist()
            at = np.array([names.get((models[r], p), -1) for r, p in zip(row.tolist(), part.tolist())], "i8")
            row, nth, at = row[at >= 0], nth[at >= 0], at[at >= 0]
            ib, qb = sizes[at, 0], sizes[at, 1]
            mix = (batch.column(0).to_numpy(zero_copy_only=False)[row] * 0x9E3779B1 >> 13) & 0x7FFFFFFF
            out = []
            whole = (ib == 1) & (qb == 1)
            own = whole & (nth == 0)
            out.append((row[own], at[own], 0 * at[own], 0 * at[own], np.full(own.sum(), BOTH)))
            asks = ~own  # each block of the index is asked by each question
            r = np.repeat(np.flatnonzero(asks), ib[asks])
            block = np.arange(len(r)) - np.repeat(np.cumsum(ib[asks]) - ib[asks], ib[asks])
            out.append((row[r], at[r], block, mix[r] % qb[r], np.full(len(r), ASKED)))
            indexed = ~whole & (nth == 0)  # and each of the index's rows stands in a block for every part of the questions
            r = np.repeat(np.flatnonzero(indexed), qb[indexed])
            block = np.arange(len(r)) - np.repeat(np.cumsum(qb[indexed]) - qb[indexed], qb[indexed])
            out.append((row[r], at[r], mix[r] % ib[r], block, np.full(len(r), INDEXED)))
            row, at, ni, nq, role = (np.concatenate(x) for x in zip(*out))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(ni.astype("i4")), pa.array(nq.astype("i4")), pa.array(role.astype("i1")), batch.column(0).take(take), batch.column(2).take(take)], names=["part", "ni", "nq", "role", "cls", "v"]
            )

    def meet(block: pa.Table) -> pa.Table:
        role, ids = block["role"].to_numpy(), block["cls"].to_numpy()
        x = _matrix(block["v"].to_pylist(), dim)
        q, b = np.flatnonzero(role != INDEXED), np.flatnonzero(role != ASKED)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        y4, foreign = x[b].astype("f4").T, role[q] == ASKED
        for i in range(0, len(q) if len(b) else 0, 1000):
            rows = q[i : i + 1000]
            s = x[rows].astype("f4") @ y4
            s[ids[rows][:, None] == ids[b][None, :]] = -2
            # of the best k + 1 of a question, and of an indexed row, the last bounds what can matter, with room for ties
            here = low - 1e-4
            floor = np.maximum(np.partition(s, -(k + 2), axis=1)[:, -(k + 2)] - 1e-5, here)[:, None] if s.shape[1] > 64 else here
            r, c = np.nonzero(s >= floor)
            exact = np.einsum("ij,ij->i", x[rows[r]], x[b[c]])
            keep = exact >= low - 1e-9
            r, c, exact = r[keep], c[keep], exact[keep].round(9)
            found.append((ids[rows[r]], ids[b[c]], exact))
            r, c = np.nonzero(s[foreign[i : i + 1000]] >= here)
            r = np.flatnonzero(foreign[i : i + 1000])[r]
            if len(r):
                exact = np.einsum("ij,ij->i", x[rows[r]], x[b[c]])
                order = np.lexsort((ids[rows[r]], -exact.round(9), c))
                r, c, exact = r[order], c[order], exact[order].round(9)
                nth = np.arange(len(c)) - np.maximum.accumulate(np.where(np.r_[True, c[1:] != c[:-1]], np.arange(len(c)), 0))
                keep = (exact >= low - 1e-9) & (nth <= k)
                found.append((ids[b[c[keep]]], ids[rows[r[keep]]], exact[keep]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
        return pa.table({"cls": pa.array(cols[0], pa.int64()), "near": pa.array(cols[1], pa.int64()), "similarity": pa.array(cols[2], pa.float64())})

    dealt = vectors.mapInArrow(deal, "part long, ni int, nq int, role tinyint, cls long, v binary")
    met = dealt.groupBy("part", "ni", "nq").applyInArrow(meet, "cls long, near long, similarity double").distinct()
    best = Window.partitionBy("cls").orderBy(F.desc("similarity"), "near")
    # each near class stands for at most k + 1 ids that matter, the smallest; k + 1 classes suffice
    top = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("cls", "near", "similarity")
    top = top.union(classes.where(F.size("ids") > 1).select("cls", F.col("cls").alias("near"), F.lit(1.0).alias("similarity")))
    wide = top.join(classes.select(F.col("cls").alias("near"), "ids"), "near").select("cls", "similarity", F.explode("ids").alias("near_id"))
    ranked = Window.partitionBy("cls").orderBy(F.desc("similarity"), "near_id")
    wide = wide.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1)
    lists = wide.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("r", "near_id", "similarity"))).alias("list"))
    # members of a class share its list; each leaves itself out
    own = member.join(lists, "cls").select("claim_id", F.slice(F.filter("list", lambda x: x["near_id"] != F.col("claim_id")), 1, k).alias("list"))
    return own.select("claim_id", F.explode("list").alias("x")).select("claim_id", "x.near_id", "x.similarity")


def similar_pairs(rows: DataFrame, opt: NeighbourOptions = NeighbourOptions()) -> DataFrame:
    """``(claim_a, claim_b)``, a < b: one is among the other's nearest."""
    near = nearest_vectors(rows, opt)
    return near.select(F.least("claim_id", "near_id").alias("claim_a"), F.greatest("claim_id", "near_id").alias("claim_b")).distinct()


def recall(rows: DataFrame, opt: NeighbourOptions = NeighbourOptions(partition_rows=64), every: int = 100) -> DataFrame:
    """``(embed_model, asked, recalled)``: per model the claims asked (ids divisible by ``every``) and whether nine tenths of their true neighbours are found.

    By default with partitions so small that a vector is asked for in few of them.
    """
    scratch = Scratch(rows.sparkSession, "recall")
    usable = scratch.save(usable_vectors(rows, opt))
    unpack = F.pandas_udf(lambda v: v.map(lambda b: np.frombuffer(b, "f4")), "array<float>")
    vectors = usable.select(F.col("claim_id").alias("id"), "model", unpack("v").alias("v"))
    asked = vectors.where(F.col("id") % every == 0)
    true = nearest_of_some(vectors, asked, opt.neighbours).where(F.col("similarity") >= opt.min_similarity).select(F.col("query_id").alias("claim_id"), F.col("id").alias("near_id"))
    found = nearest_vectors(rows, opt).where(F.col("claim_id") % every == 0).select("claim_id", "near_id", F.lit(1).alias("hit"))
    both = true.join(found, ["claim_id", "near_id"], "left").groupBy("claim_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    each = usable.where(F.col("claim_id") % every == 0).select("claim_id", F.col("model").alias("embed_model")).join(both, "claim_id", "left")
    return each.groupBy("embed_model").agg(F.count("*").alias("asked"), (F.coalesce(F.sum("hits"), F.lit(0)) >= F.lit(0.9) * F.coalesce(F.sum("n"), F.lit(0))).alias("recalled"))
