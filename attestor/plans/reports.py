"""Reports: citation checks, quote status, counter-evidence, metrics per arm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.citations import citation_marks
from attestor.functions.identity import url_key
from attestor.functions.markdown import report_parts
from attestor.functions.quotes import quote_found
from attestor.operators.ranking import cap_per
from attestor.session import Scratch, spread

# Quote states, best first.
STATES = ("found", "unverifiable", "unchecked", "not_found")


def marks(reports: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a citation mark: ``id, ord, marker, kind, target, char_offset, group_ord, quote``."""
    return reports.where(F.col(text_col).isNotNull()).select(id_col, F.explode(citation_marks(F.col(text_col))).alias("m")).select(id_col, "m.*")


def citation_targets(found: DataFrame, fetches: DataFrame, passages: DataFrame, claims: DataFrame, sources: DataFrame) -> DataFrame:
    """``kind, run_id, target, text, partial``: what the marks of reports cite.

    ``found`` has ``run_id`` beside the marks.  E is a fetch of the report's run
    by its number, P a passage with its neighbours, C a claim by the passages
    around it (the whole document without a passage), S a source by all its
    documents.  ``run_id`` is empty for all but E.  Only abstracts are partial:
    a quote that they lack may still be true.  Texts are rebuilt from passages,
    and only those of marks with a quote.
    """
    none, whole = F.lit(""), (F.lit(0), F.lit(2**31 - 1))
    docs = fetches.where("document_id is not null")
    kinds = docs.groupBy("document_id").agg((F.count_if(F.col("content_kind") == "full") == 0).alias("partial"))
    place = passages.groupBy("passage_id").agg(F.min(F.struct("document_id", "ord")).alias("at")).select("passage_id", F.col("at.document_id").alias("_doc"), F.col("at.ord").alias("_ord"))
    around = (F.coalesce(F.col("_ord") - 1, whole[0]), F.coalesce(F.col("_ord") + 1, whole[1]))
    row = lambda kind, run, target, doc, span: (F.lit(kind).alias("kind"), run.alias("run_id"), F.col(target).cast("long").alias("target"), doc.alias("document_id"), span[0].alias("lo"), span[1].alias("hi"))
    index = (
        fetches.where("run_id is not null").select(*row("E", F.col("run_id"), "seq", F.col("document_id"), whole))
        .union(place.select(*row("P", none, "passage_id", F.col("_doc"), around)))
        .union(claims.join(place, "passage_id", "left").select(*row("C", none, "claim_id", F.coalesce("_doc", "document_id"), around)))
        .union(sources.select("source_id").join(docs.select("source_id", "document_id"), "source_id", "left").select(*row("S", none, "source_id", F.col("document_id"), whole)))
    )
    key = ["kind", "run_id", "target"]
    cited = found.withColumn("run_id", F.when(F.col("kind") == "E", F.col("run_id")).otherwise("")).groupBy(*key).agg((F.count_if(F.coalesce("quote", F.lit("")) != "") > 0).alias("quoted"))
    wanted = Scratch(found.sparkSession, "cited").save(index.join(cited, key).distinct())
    span = ["document_id", "lo", "hi"]
    text = (
        wanted.where("quoted and document_id is not null").select(*span).distinct()
        .join(passages.select("document_id", "ord", "text"), "document_id").where("ord between lo and hi")
        .groupBy(*span).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))
    )
    return wanted.join(text, span, "left").join(kinds, "document_id", "left").select(*key, "text", F.coalesce("partial", F.lit(False)).alias("partial"))


def check_marks(found: DataFrame, targets: DataFrame, on: tuple[str, ...] = (), kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Marks with ``resolved`` and ``quote_status``.

    ``targets`` has ``kind, target, text`` (null text: nothing to check by), the
    further key columns ``on``, which the marks have too, and perhaps
    ``partial`` (a quote that the text lacks may still be true).  A target may
    have several rows: a quote found in any of their texts is found.  Only
    ``kinds`` (without them, those that a target row has) are checked, others
    stay unchecked (resolved is null); a mark without a quote has no status.
    """
    key = ["kind", *on, "target"]
    known = targets.select("kind").distinct() if kinds is None else targets.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    part = F.coalesce("partial", F.lit(False)) if "partial" in targets.columns else F.lit(False)
    hits = targets.groupBy(*key).agg(F.bool_and(F.col("text").isNull() | part).alias("_partial"), F.lit(True).alias("_hit"))
    quoted = found.where("quote != ''").select(*key, "quote").distinct()
    held = quoted.join(targets.where("text is not null").select(*key, "text"), key).select(*key, "quote", quote_found(F.col("quote"), F.col("text")).alias("f"))
    held = held.where("f").select(*key, "quote", F.lit(True).alias("_found")).distinct()
    m = found.join(F.broadcast(known.withColumn("_known", F.lit(True))), "kind", "left").join(hits, key, "left").join(held, [*key, "quote"], "left")
    m = m.withColumn("resolved", F.when(F.col("_known"), F.coalesce("_hit", F.lit(False))))
    status = (
        F.when(F.coalesce("quote", F.lit("")) == "", F.lit(None))
        .when(F.col("resolved").isNull(), "unchecked")
        .when(~F.col("resolved"), "not_found")
        .when(F.col("_found"), "found")
        .when(F.col("_partial"), "unverifiable")
        .otherwise("not_found")
    )
    return m.withColumn("quote_status", status).drop("_known", "_hit", "_partial", "_found")


def citation_summary(checked: DataFrame, key: str) -> DataFrame:
    """Per report: resolved, unresolved and unchecked marks, and quotes by their group's best state."""
    counts = checked.groupBy(key).agg(
        F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if(F.col("resolved").isNull()).alias("unchecked")
    )
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("quote_status"))
    best = checked.where("quote_status is not null").groupBy(key, "group_ord").agg(F.min(rank).alias("r"))
    quotes = best.groupBy(key).agg(*[F.count_if(F.col("r") == i + 1).alias(f"quotes_{s}") for i, s in enumerate(STATES)])
    return counts.join(quotes, key, "left").fillna(0, [f"quotes_{s}" for s in STATES])


def missed_quotes(checked: DataFrame, key: str) -> DataFrame:
    """Quotes that none of their group's citations bear out, per report."""
    group = checked.where("coalesce(quote, '') != '' and quote_status is not null").groupBy(key, "group_ord").agg(F.bool_and(F.col("quote_status") == "not_found").alias("missed"))
    return group.where("missed").groupBy(key).agg(F.count("*").alias("missed"))


def citation_failures(checked: DataFrame, key: str) -> DataFrame:
    """Reports with unresolved marks or missed quotes, counts of both (full outer join)."""
    unresolved = checked.where(~F.col("resolved")).groupBy(key).agg(F.count("*").alias("unresolved"))
    both = unresolved.join(missed_quotes(checked, key), key, "full")
    return both.select(key, F.coalesce("unresolved", F.lit(0)).alias("unresolved"), F.coalesce("missed", F.lit(0)).alias("missed"))


def check_notes(summary: DataFrame, failures: DataFrame, key: str, names: tuple[str, ...] = STATES) -> DataFrame:
    """``(key, notes)`` of reports with failures: a line of counts and a list of what failed.

    ``summary`` is ``citation_summary``; ``failures`` (key, ord, message).
    """
    total = F.col("resolved") + F.col("unresolved") + F.col("unchecked")
    quotes = F.col("quotes_found") + F.col("quotes_not_found") + F.col("quotes_unverifiable") + F.col("quotes_unchecked")
    head = F.format_string(
        "%d citations: %d resolved, %d unresolved, %d not checked. %d quotes: %d found, %d not found, %d unverifiable.\n\n",
        total, F.col("resolved"), F.col("unresolved"), F.col("unchecked"), quotes, F.col("quotes_found"), F.col("quotes_not_found"), F.col("quotes_unverifiable"),
    )
    listed = failures.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: F.concat(F.lit("- "), x["message"], F.lit("\n"))).alias("lines"))  # one report's failures
    return summary.join(listed, key).select(key, F.concat(head, F.array_join("lines", "")).alias("notes"))


def failure_messages(checked: DataFrame, key: str) -> DataFrame:
    """``(key, ord, message)``: unresolved marks, and quotes that none of their group's marks bear out."""
    lost = checked.where(~F.col("resolved")).select(key, "ord", F.concat(F.lit("["), "marker", F.lit("] is not in the evidence")).alias("message"))
    group = checked.where("coalesce(quote, '') != '' and quote_status is not null").groupBy(key, "group_ord").agg(
        F.bool_and(F.col("quote_status") == "not_found").alias("missed"), F.min("ord").alias("ord"), F.min_by("quote", "ord").alias("quote"), F.min_by("marker", "ord").alias("marker")
    )
    return lost.union(group.where("missed").select(key, "ord", F.concat(F.lit("the quote \u201c"), "quote", F.lit("\u201d is not in ["), "marker", F.lit("]"))))


def cited_evidence(found: DataFrame, cards: DataFrame, claims: DataFrame, key: str = "doc_id", most: int = 50) -> DataFrame:
    """The first ``most`` different P and C marks of each report as evidence: ``key, ord, marker, label, content``.

    ``cards`` (passage_id, document_id, text, site, title, age, kind), ``claims``
    (claim_id, passage_id, text, flags); a claim's evidence is the claim, its
    flags and the passage it is in.  Marks that name nothing, and claims of no
    passage, are left out.
    """
    once = found.where(F.col("kind").isin("P", "C")).groupBy(key, "marker", "kind", "target").agg(F.min("ord").alias("ord"))
    c = claims.dropDuplicates(["claim_id"]).where("passage_id is not null").select(F.lit("C").alias("kind"), F.col("claim_id").alias("target"), "passage_id", F.col("text").alias("claim"), "flags")
    p = cards.select(F.lit("P").alias("kind"), F.col("passage_id").alias("target"), "passage_id", F.lit(None).cast("string").alias("claim"), F.lit(None).cast("string").alias("flags"))
    named = once.join(p.union(c), ["kind", "target"])
    some = cap_per(named, [key], [F.col("ord"), F.col("marker")], most)
    text = some.join(cards.select("passage_id", "text", "site", "title", "age", F.col("kind").alias("card_kind")), "passage_id")
    label = F.concat(F.trim(F.concat_ws(" ", "site", "title", F.concat(F.lit("("), "age", F.lit(")")))), F.when(F.col("card_kind") == "report", ", synthesis").otherwise(""))
    flags = F.when(F.coalesce("flags", F.lit("")) != "", F.concat(F.lit("Flags: "), F.replace("flags", F.lit(","), F.lit(", ")), F.lit("\n"))).otherwise("")
    claim = F.when(F.col("claim").isNotNull(), F.concat(F.lit("Claim: "), "claim", F.lit("\n"), flags, F.lit("\n"))).otherwise("")
    return text.select(key, "ord", "marker", label.alias("label"), F.concat(claim, "text").alias("content"))


def parsed_reports(reports: DataFrame, id_col: str = "doc_id", arm_col: str = "source") -> DataFrame:
    """Each report parsed once: ``words``, the ``urls`` it cites as page keys, and ``parts`` (see ``parse_report``)."""
    r = spread(reports.where("text is not null").select(id_col, arm_col, "text"))
    r = r.select(id_col, arm_col, F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("words"), report_parts(F.col("text")).alias("parts"))
    keys = F.array_distinct(F.filter(F.transform("parts.urls", url_key), lambda k: k.isNotNull()))
    return r.select(id_col, arm_col, "words", keys.alias("urls"), "parts")


MEASURES = ("words", "listed_sources", "claims", "counter_items", "counter_sentences")


def report_metrics(parsed: DataFrame, id_col: str = "doc_id", arm_col: str = "source") -> DataFrame:
    """Words, distinct pages, listed sources, attributed claims and counter-evidence of each of ``parsed_reports``."""
    p = F.col("parts")
    return parsed.select(
        id_col, arm_col, "words", F.size("urls").alias("unique_urls"), p["listed"].alias("listed_sources"), F.size(p["claims"]).alias("claims"),
        p["counter_items"].alias("counter_items"), p["counter_sentences"].alias("counter_sentences"), p["sections"].alias("sections"),
    )


def arm_rollup(parsed: DataFrame, arm_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Per arm: summed measures, and pages counted once over all its reports (in two steps: a hot arm combines map-side)."""
    pages = parsed.select(arm_col, F.explode("urls").alias("u")).distinct().groupBy(arm_col).agg(F.count("*").alias("unique_urls")).withColumnRenamed(arm_col, "_arm")
    sums = report_metrics(parsed, id_col, arm_col).groupBy(arm_col).agg(F.count("*").alias("reports"), *[F.sum(c).alias(c) for c in MEASURES])
    return sums.join(pages, F.col(arm_col).eqNullSafe(F.col("_arm")), "left").drop("_arm").fillna(0, ["unique_urls"])


def tally(key: DataFrame, verdicts: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm: sampled, reviewed, each verdict's count, and the share supported of those reviewed."""
    names = ("supported", "partial", "unsupported", "unverifiable")
    v = verdicts.where(F.col("verdict").isin(*names)).select("id", "verdict")
    out = key.join(v, "id", "left").groupBy(arm).agg(F.count("*").alias("sampled"), F.count("verdict").alias("reviewed"), *[F.count_if(F.col("verdict") == n).alias(n) for n in names])
    return out.withColumn("rate", F.coalesce(F.try_divide(F.col("supported"), F.col("reviewed")), F.lit(0.0)))


def review_verdicts(sheet: DataFrame, text_col: str = "text") -> DataFrame:
    """``(id, verdict)`` of a review sheet: the latest ``Verdict:`` line under each ``## C01`` heading."""
    line = sheet.select(F.sha2(text_col, 256).alias("sheet"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    w = Window.partitionBy("sheet").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    own = line.withColumn("id", F.last(F.nullif(F.regexp_extract("line", r"^##\s+(C\d+)\b", 1), F.lit("")), ignorenulls=True).over(w))
    said = own.withColumn("verdict", F.lower(F.regexp_extract("line", r"(?i)^\s*verdict:\s*(\w+)", 1))).where(F.col("verdict").isin("supported", "partial", "unsupported", "unverifiable"))
    return said.where("id is not null").groupBy("id").agg(F.max_by("verdict", "n").alias("verdict"))
