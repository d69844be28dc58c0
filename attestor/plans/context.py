"""Context for a report: matched chunks of files, whole small files, evidence within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.ranking import within_budget

WHOLE, CHUNKS = 40_000, 40_000  # characters of a file taken whole, and of joined chunks


def fresh(hits: DataFrame, modified: Column, now: Column, max_age_days: float | None) -> DataFrame:
    """Hits whose file changed within the age; no age keeps all, an unknown time drops the hit."""
    if not max_age_days or max_age_days <= 0:
        return hits
    return hits.where(modified.isNotNull() & (F.unix_timestamp(modified) > F.unix_timestamp(now) - F.lit(int(max_age_days * 86_400))))


def merged_hits(parts: list[DataFrame], limit: int) -> DataFrame:
    """Hits of several projects, best score first; equal bodies count once, with their best score."""
    all_hits = parts[0]
    for p in parts[1:]:
        all_hits = all_hits.unionByName(p)
    best = all_hits.groupBy("content").agg(F.max_by(F.struct(*[c for c in all_hits.columns if c != "content"]), F.struct("score", "path")).alias("x")).select("x.*", "content")
    return best.orderBy(F.desc("score"), "path", "start_line").limit(limit)


def build_context(hits: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, mode, body)``: small files whole, others as their matched chunks in line order.

    ``hits`` (path, start_line, end_line, score, content), ``files`` (path,
    text).  A chunk of another file that a whole file contains is left out:
    chunks meet whole files by their longest inner word, or without one by
    their first three characters (or their first), so texts are compared only
    where those stand.
    """
    chunk = hits.select("path", "start_line", "end_line", "content", "score").groupBy("path", "start_line", "end_line", "content").agg(F.max("score").alias("score"))
    text = files.select("path", "text")
    mode = F.when(F.length("text") <= WHOLE, "whole").otherwise("chunks")
    paths = chunk.groupBy("path").agg(F.max("score").alias("score")).join(text, "path", "left").withColumn("mode", mode)
    whole = paths.where("mode = 'whole'").select("path", "score", "text")
    parts = chunk.drop("score").join(whole.select("path"), "path", "left_anti")
    tokens = lambda c: F.split(F.trim(c), r"\s+")
    inner = F.slice(tokens(F.col("content")), 2, F.greatest(F.size(tokens(F.col("content"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    lead = F.when(F.length("content") >= 3, F.concat(F.lit("c"), F.substring("content", 1, 3))).otherwise(F.concat(F.lit("c"), F.substring("content", 1, 1)))
    keyed = parts.withColumn("_word", F.coalesce(F.concat(F.lit("w"), longest), lead))
    chars = F.split("text", "")
    three = F.transform(F.sequence(F.lit(0), F.size(chars) - 3), lambda i: F.concat(F.lit("c"), F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
    stands = F.flatten(F.array(F.transform(tokens(F.col("text")), lambda w: F.concat(F.lit("w"), w)), F.when(F.size(chars) >= 3, three).otherwise(F.array().cast("array<string>")), F.transform(chars, lambda c: F.concat(F.lit("c"), c))))
    words = whole.select(F.explode(F.array_distinct(stands)).alias("_word"), F.col("path").alias("_whole"))
    pairs = keyed.join(words, "_word").select(F.col("path"), "start_line", "end_line", "content", "_whole").distinct()
    held = pairs.join(whole.select(F.col("path").alias("_whole"), "text"), "_whole").where(F.contains("text", "content")).select("path", "start_line", "end_line", "content").distinct()
    kept = parts.join(held, ["path", "start_line", "end_line", "content"], "left_anti")
    line = lambda c: F.concat(F.lit("[lines "), c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string"), F.lit("]\n"), F.regexp_replace(c["content"], r"^File: [^\n]*\n+", ""))
    joined = kept.groupBy("path").agg(F.array_sort(F.collect_set(F.struct("start_line", "end_line", "content"))).alias("c"))  # the hits of one file
    body = F.substring(F.array_join(F.transform("c", line), "\n\n"), 1, CHUNKS)
    rest = joined.join(paths.where("mode = 'chunks'").select("path", "score"), "path").select("path", F.lit("chunks").alias("mode"), "score", body.alias("body"))
    return whole.select("path", F.lit("whole").alias("mode"), "score", F.col("text").alias("body")).union(rest).where("body != ''").orderBy("path")


def limited_evidence(items: DataFrame, budget: int = 120_000) -> DataFrame:
    """Evidence items in order within a budget of bytes; the crossing one is cut at a character.

    ``items`` has ``ord`` and ``text``; see ``within_budget`` for long lists.
    """
    sized = items.withColumn("_all", F.lit(1)).withColumn("_n", F.octet_length("text"))
    cut = within_budget(sized, ["_all"], [F.col("ord")], F.col("_n"), budget)
    # bytes to characters: a cut inside a character drops it
    head = F.make_valid_utf8(F.substring(F.encode("text", "UTF-8"), F.lit(1), F.col("granted").cast("int")).cast("string"))
    text = F.when(F.col("granted") < F.col("_n"), F.regexp_replace(head, "\ufffd+$", "")).otherwise(F.col("text"))
    return cut.withColumn("text", text).drop("_all", "_n", "used_before", "granted")


def ledger(items: DataFrame) -> DataFrame:
    """Per shard what was captured and what was passed on: items and characters."""
    return items.groupBy("shard").agg(
        F.count("*").alias("captured"), F.sum(F.length("text")).alias("captured_chars"), F.count_if("passed").alias("passed"), F.coalesce(F.sum(F.when(F.col("passed"), F.length("text"))), F.lit(0)).alias("passed_chars")
    )


def shard_roles(topics: DataFrame, roles: list[str], n: int) -> DataFrame:
    """Each topic's ``n`` shards, roles taken in turn."""
    role = F.element_at(F.array(*map(F.lit, roles)), (F.col("shard") % len(roles) + 1).cast("int"))
    return topics.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard")).withColumn("role", role)
