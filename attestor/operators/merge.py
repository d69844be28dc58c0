"""Folds and upserts that give the same result in whatever order rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_value(value: Column, order: Column) -> Column:
    """Aggregate: the value of the earliest row that has one (not null, not empty)."""
    filled = value.isNotNull() & (value.cast("string") != "")
    return F.min_by(F.when(filled, value), F.when(filled, order))


def fold_sources(rows: DataFrame, order: str = "first_seen_at") -> DataFrame:
    """One row per ``url_key`` from old and new source rows.

    First non-empty title and DOI by arrival, a kind other than web over web,
    earliest and latest sighting.  Folding folded rows again changes nothing.
    """
    o = F.struct(F.col(order), F.col("url"))
    kinds = F.when(F.col("kind") != "web", F.col("kind"))
    return rows.groupBy("url_key").agg(
        F.min_by("url", o).alias("url"),
        first_value(F.col("domain"), o).alias("domain"),
        first_value(F.col("title"), o).alias("title"),
        F.coalesce(first_value(kinds, o), F.lit("web")).alias("kind"),
        first_value(F.col("doi"), o).alias("doi"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
    )


def fold_documents(fetches: DataFrame) -> DataFrame:
    """One row per document from its fetches (failures are left out).

    Kind full unless every fetch was an abstract; first content type, length
    and non-empty title; earliest and latest attempt; the first strong
    publication date, else the first weak one, with its precision and origin.
    """
    f = fetches.where("document_id is not null")
    o = F.struct("attempted_at", "run_id", "seq")
    weak = F.coalesce(F.col("published_weak"), F.lit(False))
    has = F.col("published").isNotNull()
    date = F.when(has, F.struct(F.col("published").alias("date"), F.col("published_precision").alias("precision"), F.col("published_from").alias("origin"), weak.alias("weak")))
    return f.groupBy("document_id").agg(
        F.min("source_id").alias("source_id"),
        F.when(F.min(F.when(F.col("content_kind") == "abstract", 1).otherwise(0)) == 1, "abstract").otherwise("full").alias("content_kind"),
        first_value(F.col("content_type"), o).alias("content_type"),
        first_value(F.col("title"), o).alias("title"),
        first_value(F.col("text_chars"), o).alias("text_chars"),
        F.min("text_sha256").alias("text_sha256"),
        F.min("attempted_at").alias("first_fetched_at"),
        F.max("attempted_at").alias("last_fetched_at"),
        F.min_by(date, F.when(has, F.struct(weak, "attempted_at", "run_id", "seq"))).alias("pub"),
    ).select(
        "*", F.col("pub.date").alias("published"), F.col("pub.precision").alias("published_precision"), F.col("pub.origin").alias("published_from"), F.col("pub.weak").alias("published_weak")
    ).drop("pub")


RELATIONS = "same supports contradicts refines supersedes unrelated".split()


def valid_links(links: DataFrame, methods: tuple[str, ...] = ("model", "human")) -> DataFrame:
    """Links between two different claims with a known relation and a loggable method."""
    return links.where(
        "from_claim is not null and to_claim is not null and from_claim != 0 and to_claim != 0 and from_claim != to_claim"
    ).where(F.col("relation").isin(RELATIONS) & F.col("method").isin(*methods))


def latest_links(links: DataFrame) -> DataFrame:
    """One row per (from, to, method): the newest line, empty texts and zero confidence as null.

    Replaying lines, or folding the result again, changes nothing; of equal
    times the larger relation by name holds.
    """
    line = F.struct("created_at", "relation", "model", "confidence", "note")
    newest = links.groupBy("from_claim", "to_claim", "method").agg(F.max(line).alias("x"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return newest.select(
        "from_claim", "to_claim", "method", "x.relation", blank("x.model").alias("model"), F.nullif(F.col("x.confidence"), F.lit(0.0).cast("float")).alias("confidence"), blank("x.note").alias("note"), "x.created_at"
    )


def not_embedded(df: DataFrame, model: str, embedding: str = "embedding", stored: str = "embed_model") -> DataFrame:
    """Rows without a vector, or with another model's (an empty model asks for any)."""
    other = F.lit(model != "") & ~F.col(stored).eqNullSafe(F.lit(model))
    return df.where(F.col(embedding).isNull() | other)


def changed(known: DataFrame, seen: DataFrame, key: str, prints: list[str]) -> DataFrame:
    """Keys of ``seen`` that are new or whose fingerprint columns differ, nulls included."""
    old = known.select(key, *[F.col(c).alias(f"old_{c}") for c in prints], F.lit(True).alias("_known"))
    differs = F.greatest(F.lit(False), *[~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in prints])
    return seen.join(old, key, "left").where(F.col("_known").isNull() | differs).select(*seen.columns)
