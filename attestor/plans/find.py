"""Hybrid evidence retrieval: text arm, vector arm, fusion, discounts, caps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.dates import age_label, date_of, precision_of
from attestor.functions.identity import on_domain
from attestor.functions.text import informative, words
from attestor.operators.joins import cosine_to
from attestor.operators.ranking import cap_per, top
from attestor.plans.claims import clusters, collapse_superseded, page_edges
from attestor.session import Scratch, spread

# Constants of fusion, discounts and caps.
FUSION, CAP, DEPTH, LEAST_DEPTH, VOLATILE_DAYS = 60, 2, 5, 50, 365
KINDS = ("passage", "report", "claim")
# Words that a text query leaves out.
STOP = """
a an and are as at be but by for from had has have he her his i if in into is it its me my no nor not of on or our she so than that the their them
then there these they this those to too very was we were what when where which while who whom why will with you your
""".split()


@dataclass(frozen=True)
class Query:
    """A checked evidence query; see the fields' checks below."""

    text: str
    limit: int = 10
    kinds: tuple[str, ...] = ()
    since: datetime | None = None
    until: datetime | None = None
    date_field: str = "published"
    as_of: datetime | None = None
    run: str = ""
    domain: str = ""
    prefer_recent_days: float = 0.0
    min_similarity: float = 0.0
    vector: tuple[float, ...] = ()
    embed_model: str = ""
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def __post_init__(self) -> None:
        if not self.text.strip():
            raise ValueError("the query text is empty")
        if set(self.kinds) - set(KINDS):
            raise ValueError(f"kinds are {KINDS}")
        if self.date_field not in ("published", "collected"):
            raise ValueError("date_field is published or collected")
        if self.since and self.until and self.until < self.since:
            raise ValueError("until is before since")
        if self.prefer_recent_days < 0 or not 0 <= self.min_similarity <= 1:
            raise ValueError("prefer_recent_days is 0 or more, min_similarity from 0 to 1")
        object.__setattr__(self, "limit", min(100, self.limit if self.limit > 0 else 10))

    @property
    def depth(self) -> int:
        return max(self.limit * DEPTH, LEAST_DEPTH)

    @property
    def terms(self) -> list[str]:
        return query_terms(self.text)


def query_terms(text: str) -> list[str]:
    return sorted({w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP})


def bounds(q: Query) -> Column:
    """The dynamic predicate over documents; a published bound drops undated rows."""
    date = date_of(F.col("published")) if q.date_field == "published" else F.to_date("first_fetched_at")
    ok = F.lit(True)
    if q.since:
        ok &= date >= F.lit(q.since.date())
    if q.until:
        ok &= date <= F.lit(q.until.date())
    if q.as_of:
        ok &= F.col("first_fetched_at") <= F.lit(q.as_of)
    if q.domain:
        ok &= on_domain(F.col("site"), q.domain)
    return ok


def bounded(q: Query) -> bool:
    return bool(q.since or q.until or q.as_of or q.domain or q.run)


def text_arm(rows: DataFrame, q: Query, id_col: str) -> DataFrame:
    """``(id, text_rank, text_hits)``: most occurrences of the query's words first.

    A look for any of the words' letters drops most rows before a text is cut
    into words.
    """
    if not q.terms:
        return rows.sparkSession.createDataFrame([], "id long, text_hits int, text_rank int")
    low = F.lower("text")
    may = reduce(lambda a, b: a | b, [low.contains(t) for t in q.terms])
    hits = F.size(F.filter(words(F.col("text")), lambda x: x.isin(q.terms)))
    found = spread(rows.select(F.col(id_col).alias("id"), "text").where(may)).select("id", hits.alias("text_hits")).where(F.col("text_hits") > 0)
    found = found.groupBy("id").agg(F.max("text_hits").alias("text_hits"))  # repeated rows fold here, without their texts
    return top(found, [F.desc("text_hits"), F.col("id")], q.depth, "text_rank")


def term_table(passages: DataFrame, id_col: str = "passage_id") -> DataFrame:
    """``(term, id, hits)``: the words of all texts, for queries that are to read no text.

    Built once at ingest and written bucketed or partitioned by term; repeated
    rows count once.  ``term_arm`` asks it.
    """
    one = passages.where("text is not null").groupBy(F.col(id_col).alias("id")).agg(F.first("text").alias("text"))
    return one.select("id", F.explode(words(F.col("text"))).alias("term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("hits"))


def term_arm(terms: DataFrame, q: Query, ids: DataFrame | None = None) -> DataFrame:
    """What ``text_arm`` gives, from a term table; ``ids`` (id) are those that the query's filters leave."""
    some = terms.where(F.col("term").isin(q.terms))
    if ids is not None:
        some = some.join(ids, "id", "left_semi")
    return top(some.groupBy("id").agg(F.sum("hits").cast("int").alias("text_hits")), [F.desc("text_hits"), F.col("id")], q.depth, "text_rank")


def vector_arm(vectors: DataFrame, q: Query, id_col: str) -> DataFrame:
    """``(id, vector_rank, similarity)``: the query model's vectors by cosine."""
    sim = vectors.where((F.col("embed_model") == q.embed_model) & F.col("embedding").isNotNull())
    sim = sim.select(F.col(id_col).alias("id"), cosine_to(F.col("embedding"), list(q.vector)).alias("similarity"))
    sim = sim.where(F.col("similarity") >= q.min_similarity).groupBy("id").agg(F.max("similarity").alias("similarity"))
    return top(sim, [F.desc(F.round("similarity", 9)), F.col("id")], q.depth, "vector_rank")


def held(rows: DataFrame, most: int) -> DataFrame:
    """A result of at most ``most`` rows as a table of the driver."""
    return rows.sparkSession.createDataFrame(rows.limit(most).collect(), rows.schema)


def _ranks(arms: list[DataFrame | None]) -> list[list]:
    """The rows of the arms, each of the query's depth at most; their jobs run side by side."""
    with ThreadPoolExecutor(max(1, len(arms))) as pool:
        return list(pool.map(lambda a: a.collect() if a is not None else [], arms))


def find(
    q: Query, passages: DataFrame, claims: DataFrame, vectors: DataFrame, documents: DataFrame, links: DataFrame | None = None, origins: DataFrame | None = None,
    passage_vectors: DataFrame | None = None, terms: DataFrame | None = None,
) -> DataFrame:
    """Ranked cards ``kind, id, document_id, title, site, score, similarity, ...``, at most ``limit``.

    ``documents`` has one row a document with site, title, dates and origin
    (primary or synthesis, whose passages are of kind report).  Claims have
    ``vectors`` (claim_id), passages perhaps ``passage_vectors`` (passage_id);
    without a query vector only texts are ranked.  Filters act inside the arms;
    ids are ranked before texts are fetched; at most CAP cards a document and
    kind remain, ties by kind and id.  Of twice the limit, with ``links`` (and
    ``origins``), claims that another card supersedes are left out, and the
    rest carry their ``flags`` and ``related`` claims.  ``terms`` is the
    passages' term table, if there is one.
    """
    kinds = set(q.kinds) or set(KINDS)
    docs = documents.where(bounds(q))
    if not {"passage", "report"} <= kinds and "claim" not in kinds:
        docs = docs.where(F.col("origin") == ("synthesis" if "report" in kinds else "primary"))
    arms = []
    if kinds & {"passage", "report"}:
        p = passages
        pdocs = docs if {"passage", "report"} <= kinds else docs.where(F.col("origin") == ("synthesis" if "report" in kinds else "primary"))
        if bounded(q) or not {"passage", "report"} <= kinds:
            p = p.join(pdocs.select("document_id"), "document_id", "left_semi")
        if q.run:
            p = p.where(F.col("run_id") == q.run)
        by_text = text_arm(p, q, "passage_id") if terms is None else term_arm(terms, q, p.select(F.col("passage_id").alias("id")).distinct() if p is not passages else None)
        v = passage_vectors.join(p.select("passage_id").distinct(), "passage_id", "left_semi") if q.vector and passage_vectors is not None else None
        arms.append((by_text, vector_arm(v, q, "passage_id") if v is not None else None, p, "passage_id"))
    if "claim" in kinds:
        c = claims.where("quote_verified")
        if bounded(q):
            c = c.join(docs.select("document_id"), "document_id", "left_semi")
        v = vectors.join(c.select("claim_id"), "claim_id", "left_semi") if q.vector else None
        arms.append((text_arm(c, q, "claim_id"), vector_arm(v, q, "claim_id") if q.vector else None, c, "claim_id"))
    cards = None
    found = _ranks([x for by_text, by_vector, *_ in arms for x in (by_text, by_vector)])
    for n, (_, _, rows, id_col) in enumerate(arms):
        ranks: dict[int, list] = {}
        for r in found[2 * n]:
            ranks.setdefault(r.id, [r.id, None, None, None])[1] = r.text_rank
        for r in found[2 * n + 1]:
            ranks.setdefault(r.id, [r.id, None, None, None])[2:] = [r.vector_rank, r.similarity]
        ids = rows.sparkSession.createDataFrame(list(ranks.values()), "id long, text_rank int, vector_rank int, similarity double")
        is_claim = id_col == "claim_id"
        extra = [F.col("as_of"), F.col("volatile")] if is_claim else [F.lit(None).cast("string").alias("as_of"), F.lit(False).alias("volatile")]
        # at most 2 x depth ids meet the texts: the scan is asked for them alone
        some = rows.where(F.col(id_col).isin(list(ranks))).select(F.col(id_col).alias("id"), "document_id", "text", *extra)
        card = some.join(F.broadcast(ids), "id").dropDuplicates(["id"]).withColumn("kind", F.lit("claim" if is_claim else "passage"))
        cards = card if cards is None else cards.unionByName(card)
    cards = docs.join(F.broadcast(cards), "document_id")
    kind = F.when(F.col("kind") == "claim", "claim").when(F.col("origin") == "synthesis", "report").otherwise("passage")
    cards = cards.withColumn("kind", kind).where(F.col("kind").isin(*kinds))

    part = lambda c: F.coalesce(1 / (F.lit(float(FUSION)) + F.col(c)), F.lit(0.0))
    score = part("text_rank") + part("vector_rank")
    score = score * F.when(F.col("kind") == "claim", 1.0).otherwise(informative(F.col("text")))
    dated = F.coalesce(date_of(F.col("as_of")), date_of(F.col("published")), F.to_date("first_fetched_at"))
    age = F.datediff(F.lit(q.now.date()), dated)
    half = F.lit(float(q.prefer_recent_days)) if q.prefer_recent_days else F.when(F.col("volatile"), F.lit(float(VOLATILE_DAYS)))
    score = score * F.coalesce(F.pow(F.lit(0.5), age / half), F.lit(1.0))
    cards = cards.withColumn("raw", score)
    order = [F.desc(F.round("raw", 12)), F.col("kind"), F.col("id")]
    cards = cap_per(cards, ["document_id", "kind"], order, CAP)
    label = age_label(
        date_of(F.col("as_of")), precision_of(F.col("as_of")), date_of(F.col("published")), precision_of(F.col("published")), F.col("published_weak"), F.col("published_from"), F.col("first_fetched_at"), F.lit(q.now)
    )
    # twice the limit, so that the collapse still leaves enough
    picked = cards.orderBy(*order).limit(2 * q.limit).withColumn("age", label)
    none = F.lit(None).cast("string")
    if links is not None and "claim" in kinds:
        picked = held(picked, 2 * q.limit)  # a page of cards, read several times
        ids = picked.where("kind = 'claim'").select(F.col("id").alias("claim_id"))
        edges = Scratch(passages.sparkSession, "edges").save(page_edges(ids, links))
        kept = collapse_superseded(picked, edges).orderBy(*order).limit(q.limit)
        near = clusters(ids, edges, claims, documents, origins, q.now, q.as_of).select(F.col("claim_id").alias("id"), F.lit("claim").alias("kind"), "flags", "related")
        picked = kept.join(near, ["id", "kind"], "left")
    else:
        picked = picked.limit(q.limit).withColumn("flags", none).withColumn("related", none)
    return picked.orderBy(*order).select(
        "kind", "id", "document_id", "title", "site", F.round("raw", 6).alias("score"), F.round("similarity", 4).alias("similarity"), "text_rank", "vector_rank", "age", "flags", "related", "text"
    )


def batch_find(passages: DataFrame, queries: DataFrame, k: int = 10, block: int = 2_000) -> DataFrame:
    """``(query_id, passage_id, hits, rank)``: the text arm of many queries at once.

    Queries ``(query_id, text)`` are a stated set and go to the tasks in blocks
    of ``block``; a task counts all words of a batch once, multiplies with the
    term-query matrix, and keeps its best ``k`` a query, so only those are
    shuffled.  Ties: the smaller passage id.
    """
    spark = passages.sparkSession
    rows = queries.where("text is not null").select("query_id", "text")
    blocks = max(1, -(-rows.count() // block))
    out = None
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else rows
        some = [(r.query_id, query_terms(r.text)) for r in part.collect()]
        vocabulary = sorted({t for _, ts in some for t in ts})
        number = {t: i for i, t in enumerate(vocabulary)}
        matrix = np.zeros((len(vocabulary), len(some)), "f4")
        for j, (_, ts) in enumerate(some):
            matrix[[number[t] for t in ts], j] = 1
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in some], "i8"), vocabulary, matrix))

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, terms, m = shared.value
            known = pa.array(terms, pa.string())
            best: list[np.ndarray] = []
            for batch in batches:
                for i in range(0, len(batch), 1_000):
                    ids, once = np.unique(batch.column(0).slice(i, 1_000).to_numpy(zero_copy_only=False), return_index=True)
                    low = pc.utf8_lower(pc.fill_null(batch.column(1).slice(i, 1_000).take(pa.array(once)), ""))
                    split = pc.split_pattern_regex(low, r"[^\pL\p{Nd}]+")
                    coded = pc.list_flatten(split).dictionary_encode()
                    own = pc.fill_null(pc.index_in(coded.dictionary, known), -1).to_numpy(zero_copy_only=False)
                    word = own[coded.indices.to_numpy(zero_copy_only=False)]
                    row = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
                    hit = word >= 0
                    counts = np.bincount(row[hit].astype("i8") * len(terms) + word[hit], minlength=len(ids) * len(terms)).reshape(len(ids), -1)
                    s = counts.astype("f4") @ m
                    take = min(k, len(ids))
                    top_rows = np.argpartition(-s, take - 1, axis=0)[:take] if len(ids) > take else np.arange(len(ids))[:, None].repeat(s.shape[1], 1)
                    floor = np.take_along_axis(s, top_rows, 0).min(0)
                    r, c = np.nonzero((s >= floor) & (s > 0))
                    best.append(np.stack([c, s[r, c].astype("i8"), ids[r]], 1))
                    if sum(map(len, best)) > 200_000:
                        best = [_cut(best, k)]
            if best:
                rows = _cut(best, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[rows[:, 0]]), pa.array(rows[:, 2]), pa.array(rows[:, 1])], names=["query_id", "passage_id", "hits"])

        some_rows = spread(passages.select(F.col("passage_id").cast("long"), "text"))
        found = some_rows.mapInArrow(count, "query_id long, passage_id long, hits long")
        out = found if out is None else out.union(found)
    # a passage delivered twice may come from two tasks
    return cap_per(out.distinct(), ["query_id"], [F.desc("hits"), F.col("passage_id")], k, "rank")


def _cut(parts: list[np.ndarray], k: int) -> np.ndarray:
    x = np.unique(np.concatenate(parts), axis=0)
    x = x[np.lexsort((x[:, 2], -x[:, 1], x[:, 0]))]
    first = np.r_[True, x[1:, 0] != x[:-1, 0]]
    rank = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
    return x[rank < k]
