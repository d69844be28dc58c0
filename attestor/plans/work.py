"""Work still to do: extraction retries, pairs to label, stale nodes, task rows, lookups."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.identity import url_key
from attestor.functions.text import share_term, words
from attestor.operators.ranking import cap_per

ATTEMPTS, PER_CHUNK = 3, 15


def extraction_work(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks to extract: of texts never tried all, of others the failed ones below ATTEMPTS tries.

    ``candidates`` (text_sha256, chunks, cited, last_fetched_at), ``state``
    (text_sha256, attempts, failed array of chunk numbers).  Cited and lately
    fetched texts come first.
    """
    j = candidates.join(state, "text_sha256", "left")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    todo = F.when(F.col("attempts").isNull(), F.when(F.col("chunks") > 0, every)).when(F.col("attempts") < ATTEMPTS, F.col("failed"))
    out = j.select("text_sha256", "cited", "last_fetched_at", F.explode(todo).alias("chunk"))
    return out.orderBy(F.desc("cited"), F.desc("last_fetched_at"), "text_sha256", "chunk")


def new_neighbours(near: DataFrame, claims: DataFrame, links: DataFrame, origins: DataFrame, k: int = 5, min_similarity: float = 0.75) -> DataFrame:
    """``(claim_id, near_id, similarity, rank)``: of each claim's nearest ones the first ``k`` worth linking.

    ``near`` (query_id, id, similarity) holds the nearest 4 x ``k`` verified
    claims; of those, claims of the own origin, below ``min_similarity`` or
    with a link either way are left out (equal similarity: smaller id first).
    A document without a row in ``origins`` is its own origin.
    """
    own = claims.where("quote_verified").dropDuplicates(["claim_id"]).select("claim_id", "document_id")
    root = origins.groupBy("document_id").agg(F.min("origin_id").alias("root"))
    own = own.join(root, "document_id", "left").select("claim_id", F.coalesce("root", "document_id").alias("root"))
    side = lambda c, r: own.select(F.col("claim_id").alias(c), F.col("root").alias(r))
    pair = near.where(F.col("similarity") >= min_similarity).select(F.col("query_id").alias("claim_id"), F.col("id").alias("near_id"), "similarity")
    pair = pair.join(side("claim_id", "ra"), "claim_id").join(side("near_id", "rb"), "near_id").where("ra != rb")
    known = links.select(F.explode(F.array(F.struct(F.col("from_claim").alias("claim_id"), F.col("to_claim").alias("near_id")), F.struct(F.col("to_claim").alias("claim_id"), F.col("from_claim").alias("near_id")))).alias("x")).select("x.*").distinct()
    return cap_per(pair.join(known, ["claim_id", "near_id"], "left_anti").select("claim_id", "near_id", "similarity"), ["claim_id"], [F.desc("similarity"), F.col("near_id")], k, "rank")


def mark_checked(claims: DataFrame, checked: DataFrame, now: datetime) -> DataFrame:
    """``claims`` with ``link_checked_at`` set for those in ``checked`` (claim_id)."""
    done = checked.select("claim_id").distinct().withColumn("_done", F.lit(now))
    old = F.col("link_checked_at") if "link_checked_at" in claims.columns else F.lit(None).cast("timestamp")
    wide = claims.join(done, "claim_id", "left")
    return wide.select(*[F.col(c) for c in claims.columns if c != "link_checked_at"], F.coalesce("_done", old).alias("link_checked_at"))


def pairs_to_label(near: DataFrame, claims: DataFrame, links: DataFrame, day_budget: int, now: datetime) -> DataFrame:
    """Claim pairs to ask a model about, the most similar first, within what the day's budget leaves.

    ``near`` (query_id, id, similarity); pairs need a shared telling word, two
    documents and no link either way.
    """
    c = claims.dropDuplicates(["claim_id"]).select("claim_id", "document_id", "text")
    side = lambda x: c.select(F.col("claim_id").alias(x), F.col("document_id").alias(f"d_{x}"), F.col("text").alias(f"t_{x}"))
    pair = near.groupBy(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).agg(F.max("similarity").alias("similarity"))
    known = links.select(F.least("from_claim", "to_claim").alias("a"), F.greatest("from_claim", "to_claim").alias("b")).distinct()
    pair = pair.join(known, ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b").where((F.col("d_a") != F.col("d_b")) & share_term(F.col("t_a"), F.col("t_b")))
    used = links.where((F.col("method") == "model") & (F.col("created_at") >= F.lit(now - timedelta(days=1)))).count()
    return pair.select("a", "b", "similarity").orderBy(F.desc("similarity"), "a", "b").limit(max(0, day_budget - used))


def node_changes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``(id, state)``: nodes whose file is gone (orphaned, if not flagged yet) or newer than they are (stale).

    ``nodes`` (id, path, updated_at, orphaned); nodes without a path are left out.
    """
    j = nodes.where("coalesce(path, '') != ''").join(files.select("path", "modified"), "path", "left")
    state = F.when(F.col("modified").isNull() & ~F.coalesce("orphaned", F.lit(False)), "orphaned").when(F.col("modified") > F.col("updated_at"), "stale")
    return j.select("id", state.alias("state")).where("state is not null")


def find_nodes(nodes: DataFrame, key: str, value: str, limit: int = 100) -> DataFrame:
    """Nodes by title (case aside), path, normalized URL, or a metadata value or list member.

    ``nodes`` (id, title, path, metadata map of JSON texts, updated_at).
    """
    if key == "title":
        hit = F.lower("title") == value.lower()
    elif key == "path":
        hit = F.col("path") == value
    elif key == "url":
        hit = url_key(F.try_element_at("metadata", F.lit("url"))) == url_key(F.lit(value))
    else:
        raw = F.try_element_at("metadata", F.lit(key))
        hit = (raw == value) | F.coalesce(F.array_contains(F.from_json(raw, "array<string>"), value), F.lit(False))
    return nodes.where(F.coalesce(hit, F.lit(False))).orderBy(F.desc("updated_at"), "id").limit(limit)


def by_prefix(df: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """Rows whose id is or begins with a prefix."""
    return df.where(F.col(id_col).startswith(prefix))


def next_tasks(tasks: DataFrame, now: datetime, n: int = 1) -> DataFrame:
    """The queued tasks to run next: no parent, no live lease, by priority, then age."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") < F.lit(now))
    return tasks.where((F.col("status") == "queued") & F.col("parent_task_id").isNull() & free).orderBy(F.desc("priority"), "created_at", "id").limit(n)


def child_tasks(tasks: DataFrame) -> DataFrame:
    """One row per worker in a task's metadata: ``parent, n, shard, status`` (error or done)."""
    w = F.from_json("metadata", "workers array<struct<shard:string,error:string>>")["workers"]
    rows = tasks.select(F.col("id").alias("parent"), F.posexplode(w).alias("n", "w"))
    return rows.select("parent", "n", F.col("w.shard").alias("shard"), F.when(F.coalesce("w.error", F.lit("")) != "", "error").otherwise("done").alias("status"))


def evidence_ids(items: DataFrame, run: str, order: list[Column]) -> DataFrame:
    """Items of each run named E1, E2, ... in order."""
    return items.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("string")))


def matched_sources(claims: DataFrame, sources: DataFrame, key: str, most: int = 2) -> DataFrame:
    """Up to ``most`` listed sources of the same report per claim: two points a shared capitalized word, one a shared year.

    ``claims`` (key, claim, text), ``sources`` (key, pos, line); at least two
    points, ties by position.  Both sides are one report's, so the join is
    within the report.
    """
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(\p{Lu}\p{L}{2,})"), F.lit(1)))
    years = lambda c: F.array_distinct(F.filter(words(c), lambda w: w.rlike(r"^(1[5-9]|20)\d{2}$")))
    j = claims.join(sources, key)
    score = 2 * F.size(F.array_intersect(names(F.col("text")), names(F.col("line")))) + F.size(F.array_intersect(years(F.col("text")), years(F.col("line"))))
    ranked = j.withColumn("score", score).where("score >= 2").withColumn("rank", F.row_number().over(Window.partitionBy(key, "claim").orderBy(F.desc("score"), "pos")))
    return ranked.where(F.col("rank") <= most).select(key, "claim", "pos", "line", "score", "rank")
