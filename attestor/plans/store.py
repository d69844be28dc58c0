"""Questions about the store: counts, runs, attempts, health, work still to do."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.joins import neighbours
from attestor.operators.ranking import best_per, cap_per


def deliveries(fetches: DataFrame) -> DataFrame:
    """Fetch records without repeated deliveries: one row per (run_id, seq)."""
    return fetches.dropDuplicates(["run_id", "seq"])


def fetch_class(status: Column, error: Column) -> Column:
    """ok, blocked, dead or error, as status and error say."""
    return (
        F.when(status.between(200, 399) & error.isNull(), "ok").when(status.isin(401, 403, 429, 999), "blocked").when(status.isin(404, 410) | F.coalesce(error, F.lit("")).rlike("(?i)no such host|nxdomain"), "dead").otherwise("error")
    )


def class_counts(fetches: DataFrame) -> DataFrame:
    """Fetches per run and class, zeros included."""
    c = deliveries(fetches).select("run_id", fetch_class(F.col("http_status"), F.col("error")).alias("class"))
    return c.groupBy("run_id").pivot("class", ["ok", "blocked", "dead", "error"]).count().fillna(0)


def first_sightings(fetches: DataFrame) -> DataFrame:
    """The earliest fetch of each source, by run and sequence."""
    return best_per(deliveries(fetches), ["source_id"], [F.col("run_id"), F.col("seq")]).select("source_id", "run_id", "seq", "reason")


def best_attempts(fetches: DataFrame, keys: tuple[str, ...] = ("run_id", "source_id")) -> DataFrame:
    """Per key the attempt with a document, else the latest."""
    order = [F.col("document_id").isNotNull().desc(), F.desc("attempted_at"), F.desc("seq")]
    return best_per(deliveries(fetches), list(keys), order)


def run_sources(fetches: DataFrame, sources: DataFrame, passages: DataFrame) -> DataFrame:
    """Per run and source: attempts, the best attempt's outcome, its document's passages, sequence numbers."""
    f = deliveries(fetches)
    five = cap_per(f.select("run_id", "source_id", "seq"), ["run_id", "source_id"], [F.col("seq")], 5)  # deliveries are distinct by seq
    five = five.groupBy("run_id", "source_id").agg(F.array_join(F.array_sort(F.collect_list("seq")), ",").alias("seqs"))
    seen = f.groupBy("run_id", "source_id").agg(F.count("*").alias("tried"), F.min("seq").alias("first_seq")).join(five, ["run_id", "source_id"])
    best = best_attempts(fetches).select("run_id", "source_id", "document_id", fetch_class(F.col("http_status"), F.col("error")).alias("outcome"))
    size = passages.dropDuplicates(["passage_id"]).groupBy("document_id").agg(F.count("*").alias("passages"))
    out = seen.join(best, ["run_id", "source_id"]).join(sources.select("source_id", "url_key", "title"), "source_id").join(size, "document_id", "left")
    out = out.select("run_id", "source_id", "url_key", "title", "tried", "first_seq", "seqs", "document_id", "outcome", F.coalesce("passages", F.lit(0)).alias("passages"))
    # sources with a document first, then as they were met
    return out.orderBy("run_id", F.col("document_id").isNull(), "first_seq", "source_id")


def passage_cards(passages: DataFrame, n: int = 1) -> DataFrame:
    """Passages with the ids of their neighbours in the document."""
    p = passages.dropDuplicates(["passage_id"]).select("passage_id", "document_id", "ord", "char_start", "char_end")
    p = neighbours(p, ["document_id"], "ord", "passage_id", n)
    return p.withColumn("before", F.array_join("before", ",")).withColumn("after", F.array_join("after", ","))


def document_slice(text: Column, offset: int, chars: int = 8_000) -> Column:
    """``struct<text, truncated>``: a page of a text by code points, at most 50,000."""
    n = min(max(1, chars), 50_000)
    return F.struct(F.substring(text, offset + 1, n).alias("text"), (F.length(text) > offset + n).alias("truncated"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(name, rows)`` of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


def claim_counts(claims: DataFrame, vectors: DataFrame, links: DataFrame) -> DataFrame:
    """Claims, those unverified, without a vector and without a link, and links by method."""
    c = claims.dropDuplicates(["claim_id"]).select("claim_id", "quote_verified")
    v = vectors.where("embedding is not null").select("claim_id", F.lit(True).alias("v")).distinct()
    ends = links.select(F.explode(F.array("from_claim", "to_claim")).alias("claim_id")).distinct().withColumn("l", F.lit(True))
    a = c.join(v, "claim_id", "left").join(ends, "claim_id", "left").agg(
        F.count("*").alias("claims"), F.count_if(~F.col("quote_verified")).alias("unverified"), F.count_if(F.col("v").isNull()).alias("unembedded"), F.count_if(F.col("l").isNull()).alias("unlinked")
    )
    b = links.agg(F.count("*").alias("link_lines"), F.count_if(F.col("method") == "model").alias("model_lines"), F.count_if(F.col("method") == "human").alias("human_lines"))
    return a.crossJoin(F.broadcast(b))  # one row each


def model_links_since(links: DataFrame, since: datetime) -> DataFrame:
    return links.where((F.col("method") == "model") & (F.col("created_at") >= F.lit(since))).agg(F.count("*").alias("n"))


def claim_candidates(fetches: DataFrame, claims: DataFrame, least_chars: int = 200) -> DataFrame:
    """Texts worth extracting claims from: per text hash its title, length, whether cited, latest fetch.

    Texts below ``least_chars`` or with claims already are left out.
    """
    done = claims.select("document_id").distinct()
    f = deliveries(fetches).where("document_id is not null and text_sha256 is not null").join(done, "document_id", "left_anti")
    t = f.groupBy("text_sha256").agg(
        F.max("title").alias("title"), F.max("text_chars").alias("chars"), F.bool_or(F.col("reason") == "cited").alias("cited"), F.max("attempted_at").alias("last_fetched_at")
    )
    return t.where(F.col("chars") >= least_chars)


def fetch_plan(fetches: DataFrame) -> DataFrame:
    """What to fetch per run, once a source: the best reason (cited, opened, result, ingest) and rank.

    Sources that already have a document are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, ("cited", "opened", "result", "ingest"))), F.col("reason"))
    f = deliveries(fetches)
    best = f.groupBy("run_id", "source_id").agg(F.min(F.struct(rank.alias("p"), F.coalesce("hit_rank", F.lit(2**31 - 1)).alias("hit"), F.col("reason"))).alias("x"), F.min("seq").alias("first_seq"))
    have = f.where("document_id is not null").select("source_id").distinct()
    out = best.join(have, "source_id", "left_anti").select("run_id", "source_id", "x.reason", F.nullif(F.col("x.hit"), F.lit(2**31 - 1)).alias("hit_rank"), "first_seq", "x.p")
    # by reason, results by rank, then as they were met
    return out.orderBy("run_id", "p", F.when(F.col("reason") == "result", F.coalesce("hit_rank", F.lit(2**31 - 1))), "first_seq", "source_id").drop("p")


def run_health(fetches: DataFrame, passages: DataFrame) -> DataFrame:
    """Per run: fetches, failures, repeats delivered, sequence gaps, late rows, passages."""
    f = fetches.groupBy("run_id", "seq").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"), F.min("attempted_at").alias("at"))
    a = f.groupBy("run_id").agg(
        F.count("*").alias("fetches"), F.count_if(F.col("document_id").isNull()).alias("failed"), F.sum(F.col("n") - 1).alias("repeats"), (F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("gaps"),
        F.date_format(F.min("at"), "yyyy-MM-dd").alias("oldest"), F.date_format(F.max("at"), "yyyy-MM-dd").alias("newest"),
    )
    p = passages.groupBy("run_id").agg(F.count_distinct("passage_id").alias("passages"))
    return a.join(p, "run_id", "left").fillna(0, ["passages"])


def problems(tables: dict[str, DataFrame]) -> DataFrame:
    """``(severity, message, n)`` of what looks wrong in the store (zero counts are left out)."""
    checks: list[tuple[str, str, Callable[[], DataFrame]]] = [
        ("error", "claims of passages that are not there", lambda: tables["claims"].join(tables["passages"].select("passage_id"), "passage_id", "left_anti")),
        ("error", "links to claims that are not there", lambda: tables["claim_links"].select(F.explode(F.array("from_claim", "to_claim")).alias("claim_id")).join(tables["claims"].select("claim_id"), "claim_id", "left_anti")),
        ("warning", "claims whose quote is not verified", lambda: tables["claims"].where(~F.col("quote_verified"))),
        ("warning", "sources without a document", lambda: tables["sources"].join(tables["fetches"].where("document_id is not null").select("source_id"), "source_id", "left_anti")),
        ("warning", "links of a claim to itself", lambda: tables["claim_links"].where("from_claim = to_claim")),
        ("note", "fetches delivered more than once", lambda: tables["fetches"].groupBy("run_id", "seq").agg(F.count("*").alias("n")).where("n > 1")),
    ]
    out = None
    for severity, message, rows in checks:
        one = rows().agg(F.count("*").alias("n")).select(F.lit(severity).alias("severity"), F.lit(message).alias("message"), "n")
        out = one if out is None else out.union(one)
    return out.where("n > 0")


def latest_sightings(sightings: DataFrame, captures: DataFrame, most: int = 20) -> DataFrame:
    """Where each source was seen, the latest first, at most ``most`` a source: sightings of captures that exist, by run and number."""
    when = captures.groupBy("run_id", "seq").agg(F.max("captured_at").alias("captured_at"))
    both = sightings.drop("captured_at").join(when, ["run_id", "seq"])
    return cap_per(both, ["source_id"], [F.desc("captured_at"), F.desc("run_id"), F.desc("seq"), F.col("ord")], most, "rank")


def ungrouped_documents(documents: DataFrame, origins: DataFrame) -> DataFrame:
    """Primary documents without an origin: while there is any, origins are to be grouped again."""
    return documents.where("origin = 'primary'").join(origins.select("document_id"), "document_id", "left_anti").select("document_id")


def call_summary(calls: DataFrame) -> DataFrame:
    """Per provider and model: calls, failures, tokens in and out, mean and largest latency (null tokens and times count for nothing)."""
    return calls.groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.round(F.avg("latency_ms"), 3).alias("mean_ms"), F.max("latency_ms").alias("most_ms"),
    )
