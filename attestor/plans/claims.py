"""The claim graph: holding relations, clusters with flags, timelines, cards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions.dates import date_of
from attestor.functions.text import quote_key
from attestor.operators.ranking import cap_per
from attestor.session import Scratch

# Relations as seen from the claim they point to.
REVERSED = {"refines": "refined_by", "supersedes": "superseded_by"}
OUTDATED_DAYS, LEAST_WORDS = 30, 6


def method_rank(method: Column) -> Column:
    return F.when(method == "human", 1).when(method == "model", 2).when(method == "rule", 3).otherwise(4)


def claim_relations(links: DataFrame) -> DataFrame:
    """The link that holds per unordered pair: human over model over rule, then the latest.

    ``(a, b, from_claim, to_claim, relation, method, created_at)``, a < b.
    ``unrelated`` can hold and then suppresses the pair; drop it afterwards.
    Self links and null ends count for nothing; ties go to the smaller
    ``from_claim``.  An aggregate, so many lines of a pair fold map-side.
    """
    line = F.struct(
        (-method_rank(F.col("method"))).alias("m"), F.col("created_at"), (-F.col("from_claim")).alias("f"), "from_claim", "to_claim", "relation", "method"
    )
    pair = links.where("from_claim != to_claim").groupBy(F.least("from_claim", "to_claim").alias("a"), F.greatest("from_claim", "to_claim").alias("b"))
    return pair.agg(F.max(line).alias("x")).select("a", "b", "x.from_claim", "x.to_claim", "x.relation", "x.method", "x.created_at")


def directed(relations: DataFrame) -> DataFrame:
    """``(claim_id, other_id, relation)``: each holding link from both of its ends."""
    live = relations.where("relation != 'unrelated'")
    back = F.coalesce(*[F.when(F.col("relation") == k, F.lit(v)) for k, v in REVERSED.items()], F.col("relation"))
    sides = F.explode(
        F.array(
            F.struct(F.col("from_claim").alias("claim_id"), F.col("to_claim").alias("other_id"), F.col("relation").alias("relation")),
            F.struct(F.col("to_claim").alias("claim_id"), F.col("from_claim").alias("other_id"), back.alias("relation")),
        )
    )
    return live.select(sides.alias("s")).select("s.*")


def dated_claims(claims: DataFrame, documents: DataFrame, origins: DataFrame) -> DataFrame:
    """One row a claim with its document's dates, its effective date and its origin."""
    own = claims.dropDuplicates(["claim_id"]).select("claim_id", "document_id", "text", "as_of", "volatile", "quote_verified")
    doc = documents.select("document_id", "published", F.to_date("first_fetched_at").alias("collected"), F.to_date("last_fetched_at").alias("confirmed"))
    root = origins.groupBy("document_id").agg(F.min("origin_id").alias("origin_id"))
    out = own.join(doc, "document_id").join(root, "document_id", "left")
    return out.select(
        "*", F.coalesce(date_of(F.col("as_of")), date_of(F.col("published")), F.col("collected")).alias("dated"), F.coalesce("origin_id", "document_id").alias("own_origin")
    )


def touching(links: DataFrame, ids: DataFrame) -> DataFrame:
    """All lines of the pairs that have one of ``ids`` (claim_id, a checked small set) at an end."""
    one = F.broadcast(ids.select("claim_id").distinct())
    near = links.join(one.withColumnRenamed("claim_id", "from_claim"), "from_claim", "left_semi")
    return near.unionByName(links.join(one.withColumnRenamed("claim_id", "to_claim"), "to_claim", "left_semi")).select(links.columns)


# The order of a cluster, what bears on the claim most first.
RELATION_ORDER = "superseded_by contradicts same supports refined_by refines supersedes".split()


def related_in_order(edges: DataFrame, known: DataFrame, shown: int) -> DataFrame:
    """``(claim_id, related)``: each claim's relatives in order, ``relation claim date`` apart by semicolons, ``shown`` at most.

    By relation (see RELATION_ORDER), then the newest, then the smaller id.
    """
    rows = edges.join(known.select(F.col("claim_id").alias("other_id"), "dated"), "other_id")
    order = F.array_position(F.array(*map(F.lit, RELATION_ORDER)), F.col("relation"))
    some = cap_per(rows.withColumn("o", order), ["claim_id"], [F.col("o"), F.desc("dated"), F.col("other_id")], shown, "rank")
    line = F.concat_ws(" ", "relation", F.col("other_id").cast("string"), F.date_format("dated", "yyyy-MM-dd"))
    return some.groupBy("claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "; ").alias("related"))


def page_edges(ids: DataFrame, links: DataFrame) -> DataFrame:
    """``(claim_id, other_id, relation)`` of a small set of claims, as those of a page of cards; only their pairs' links are read."""
    ids = ids.select("claim_id").distinct()
    return directed(claim_relations(touching(links, ids))).join(F.broadcast(ids), "claim_id", "left_semi")


def clusters(ids: DataFrame, edges: DataFrame, claims: DataFrame, documents: DataFrame, origins: DataFrame, now: datetime, as_of: datetime | None = None, shown: int = 20) -> DataFrame:
    """``(claim_id, flags, related)`` of a small set of claims with their ``page_edges``."""
    ids = ids.select("claim_id").distinct()
    need = ids.union(edges.select("other_id")).distinct()
    known = dated_claims(claims.join(need, "claim_id", "left_semi"), documents, origins)
    if as_of:
        known = known.where(F.col("collected") <= F.lit(as_of.date()))
    known = Scratch(claims.sparkSession, "clusters").save(known)
    flags = flags_of(known.join(F.broadcast(ids), "claim_id", "left_semi"), edges, known, now).select("claim_id", "flags")
    return flags.join(related_in_order(edges, known, shown), "claim_id", "left")


def claim_flags(claims: DataFrame, links: DataFrame, documents: DataFrame, origins: DataFrame, now: datetime, as_of: datetime | None = None) -> DataFrame:
    """Per claim its one-hop cluster and flags.

    ``origins`` counts the claim's own origin and those of claims that say the
    same or support it; a claim is reinforced from two on.  Flags in fixed
    order: reinforced or single_origin, contested, newer_contradiction (the
    newest contradiction is later than the last supporting date), superseded,
    possibly_outdated (volatile and older than 30 days).  With ``as_of``,
    claims collected later are left out.
    """
    known = dated_claims(claims, documents, origins)
    if as_of:
        known = known.where(F.col("collected") <= F.lit(as_of.date()))
    return flags_of(known, directed(claim_relations(links)), known, now)


def flags_of(wanted: DataFrame, edges: DataFrame, known: DataFrame, now: datetime) -> DataFrame:
    """The rows of ``claim_flags`` for the claims of ``wanted``, from their edges and the dated claims at the other ends."""
    other = known.select(F.col("claim_id").alias("other_id"), F.col("dated").alias("o_dated"), F.col("own_origin").alias("o_origin"), F.col("confirmed").alias("o_confirmed"))
    edges = edges.join(other, "other_id")
    supports = F.col("relation").isin("same", "supports")
    # one row a claim and origin first: a claim with very many supporters folds map-side, and no list of them is gathered
    own = wanted.select("claim_id", "own_origin")
    by_origin = edges.join(own, "claim_id").groupBy("claim_id", F.when(supports & (F.col("o_origin") != F.col("own_origin")), F.col("o_origin")).alias("other_origin")).agg(
        F.max(F.when(supports, F.col("o_dated"))).alias("sl"), F.min(F.when(supports, F.col("o_dated"))).alias("sf"), F.max(F.when(supports, F.col("o_confirmed"))).alias("sc"),
        F.max(F.when(F.col("relation") == "contradicts", F.col("o_dated"))).alias("al"), F.count_if(F.col("relation") == "contradicts").alias("nc"), F.count_if(F.col("relation") == "superseded_by").alias("ns"), F.count("*").alias("n"),
    )
    cluster = by_origin.groupBy("claim_id").agg(
        F.count("other_origin").alias("support_origins"), F.max("sl").alias("support_last"), F.min("sf").alias("support_first"), F.max("sc").alias("support_confirmed"), F.max("al").alias("against_last"),
        F.sum("nc").alias("contradictions"), F.sum("ns").alias("superseders"), F.sum("n").alias("related"),
    )
    c = wanted.join(cluster, "claim_id", "left")
    count = F.coalesce("support_origins", F.lit(0)) + 1
    last = F.greatest("dated", "support_last")
    first = F.least("dated", "support_first")
    days = F.datediff(F.lit(now.date()), last)
    flag = lambda when, name: F.when(when, F.lit(name))
    flags = F.array(
        F.when(count >= 2, F.lit("reinforced")).otherwise(F.lit("single_origin")),
        flag(F.coalesce("contradictions", F.lit(0)) > 0, "contested"),
        flag(F.col("against_last") > last, "newer_contradiction"),
        flag(F.coalesce("superseders", F.lit(0)) > 0, "superseded"),
        flag(F.col("volatile") & (days > OUTDATED_DAYS), "possibly_outdated"),
    )
    return c.select(
        "claim_id",
        "document_id",
        count.alias("origins"),
        F.coalesce("related", F.lit(0)).alias("related"),
        F.date_format("dated", "yyyy-MM-dd").alias("dated"),
        F.when(F.year(first) != F.year(last), F.concat_ws("-", F.year(first), F.year(last))).alias("support_dates"),
        F.date_format(F.greatest("confirmed", "support_confirmed"), "yyyy-MM-dd").alias("last_confirmed"),
        F.array_join(F.filter(flags, lambda x: x.isNotNull()), ",").alias("flags"),
    )


def timeline(seeds: DataFrame, claims: DataFrame, links: DataFrame, documents: DataFrame, origins: DataFrame) -> DataFrame:
    """Seeds and their one-hop relatives by date, with what each changes.

    ``seeds`` has ``claim_id``.  Superseding and refining are noted on the
    newer end's row (the ``from`` claim), contradictions on the later dated
    one (ties keep ``from``).
    """
    relations = claim_relations(links).where("relation != 'unrelated'")
    hop = directed(relations).join(seeds.select("claim_id").distinct(), "claim_id", "left_semi").select(F.col("other_id").alias("claim_id"))
    ids = seeds.select("claim_id", F.lit(True).alias("matched")).union(hop.select("claim_id", F.lit(False))).groupBy("claim_id").agg(F.max("matched").alias("matched"))
    known = dated_claims(claims, documents, origins).join(ids, "claim_id")
    day = known.select("claim_id", "dated")
    both = (
        relations.join(day.select(F.col("claim_id").alias("from_claim"), F.col("dated").alias("d_from")), "from_claim")
        .join(day.select(F.col("claim_id").alias("to_claim"), F.col("dated").alias("d_to")), "to_claim")
        .where(F.col("relation").isin("supersedes", "refines", "contradicts"))
    )
    turn = (F.col("relation") == "contradicts") & (F.col("d_to") > F.col("d_from"))
    change = both.select(
        F.when(turn, F.col("to_claim")).otherwise(F.col("from_claim")).alias("claim_id"),
        F.concat_ws(" ", "relation", F.when(turn, F.col("from_claim")).otherwise(F.col("to_claim")).cast("string"), F.concat(F.lit("("), F.date_format(F.when(turn, F.col("d_from")).otherwise(F.col("d_to")), "yyyy-MM-dd"), F.lit(")"))).alias("change"),
    )
    changes = change.groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("change")), "; ").alias("changes"))
    return known.join(changes, "claim_id", "left").select(
        F.date_format("dated", "yyyy-MM-dd").alias("dated"), "claim_id", "matched", F.coalesce("changes", F.lit("")).alias("changes")
    )


def quoted_claims(claims: DataFrame) -> DataFrame:
    """``(k, claim_id, document_id, extracted_at)`` of the verified quotes of LEAST_WORDS or more, one row a claim."""
    key = quote_key(F.col("quote"))
    c = claims.where("quote_verified and claim_id is not null and document_id is not null").dropDuplicates(["claim_id"]).select(key.alias("k"), "claim_id", "document_id", "extracted_at")
    return c.where(F.size(F.split("k", " ")) >= LEAST_WORDS)


def rule_links(claims: DataFrame) -> DataFrame:
    """Claims of different documents with the same verified quote of six words or more.

    Not all pairs: every claim is linked to the quote's smallest claim, and the
    other claims of that one's document to the smallest claim of any other
    document.  Each claim that has a partner in another document has a link,
    and the groups are those of all pairs (``rule_groups`` has how many there
    are).  ``(from_claim, to_claim, relation, method, created_at)``, from < to.
    """
    c = quoted_claims(claims)
    first = F.min(F.struct("claim_id", "document_id", "extracted_at"))
    head = c.groupBy("k").agg(first.alias("h"))
    apart = c.join(head, "k").where(F.col("document_id") != F.col("h.document_id"))
    second = apart.groupBy("k").agg(first.alias("o"))
    pair = c.join(head, "k").join(second, "k").select("claim_id", "extracted_at", F.when(F.col("document_id") == F.col("h.document_id"), F.col("o")).otherwise(F.col("h")).alias("x"))
    return pair.select(
        F.least("claim_id", "x.claim_id").alias("from_claim"), F.greatest("claim_id", "x.claim_id").alias("to_claim"), F.lit("same").alias("relation"), F.lit("rule").alias("method"), F.greatest("extracted_at", "x.extracted_at").alias("created_at")
    ).distinct()


def rule_groups(claims: DataFrame) -> DataFrame:
    """``(claim_id, group_id, links)``: each claim of ``rule_links`` with its group and the number of claims of other documents with its quote."""
    c = quoted_claims(claims)
    own = c.groupBy("k", "document_id").agg(F.count("*").alias("n"), F.min("claim_id").alias("m"))
    whole = own.groupBy("k").agg(F.sum("n").alias("all"), F.min("m").alias("group_id"))
    counts = own.join(whole, "k").where(F.col("all") > F.col("n")).select("k", "document_id", "group_id", (F.col("all") - F.col("n")).alias("links"))
    return c.join(counts, ["k", "document_id"]).select("claim_id", "group_id", "links")


def collapse_superseded(cards: DataFrame, edges: DataFrame) -> DataFrame:
    """Claim cards (a page of them, with their ``page_edges``) without those that another card present supersedes."""
    present = cards.where("kind = 'claim'").select(F.col("id").alias("other_id"))
    gone = edges.where("relation = 'superseded_by'").join(F.broadcast(present), "other_id", "left_semi").select(F.col("claim_id").alias("id"), F.lit("claim").alias("kind")).distinct()
    return cards.join(F.broadcast(gone), ["id", "kind"], "left_anti")
