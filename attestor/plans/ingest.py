"""From the store's files to tables: sources, sightings, fetches, documents, passages, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.functions.dates import date_of, precision_of
from attestor.functions.identity import doi_of, domain_of, hash63, joined_id, source_kind, url_key
from attestor.functions.passages import passages as passages_of
from attestor.functions.quotes import locate_quote
from attestor.functions.text import quote_key
from attestor.operators import joins, merge
from attestor.sources import files


def sightings(captures: DataFrame) -> DataFrame:
    """``run_id, seq, ord, url, url_key, role, rank, title, snippet, captured_at``.

    Results in order, then the page a capture opened if it was not among them;
    only URLs with a key count, and ``ord`` numbers those.
    """
    results = captures.select("run_id", "seq", "captured_at", F.posexplode(F.coalesce("results", F.array().cast(captures.schema["results"].dataType))).alias("pos", "r"))
    seen = results.select("run_id", "seq", "captured_at", "pos", F.col("r.url").alias("url"), F.when(F.col("r.opened"), "opened").otherwise("result").alias("role"), F.col("r.rank").alias("rank"), F.col("r.title").alias("title"), F.col("r.snippet").alias("snippet"))
    page = captures.where("coalesce(url, '') != ''").select(
        "run_id", "seq", "captured_at", F.lit(2**31 - 1).alias("pos"), "url", F.when(F.col("action") == "fetch", "fetched").otherwise("opened").alias("role"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet")
    )
    both = seen.union(page).withColumn("url_key", url_key(F.col("url"))).where("url_key is not null")
    own = Window.partitionBy("run_id", "seq", "url_key")
    both = both.withColumn("_n", F.count("*").over(own)).where((F.col("pos") != 2**31 - 1) | (F.col("_n") == 1))
    w = Window.partitionBy("run_id", "seq").orderBy("pos")
    return both.withColumn("ord", F.row_number().over(w) - 1).drop("pos", "_n")


def sources_of(seen: DataFrame, fetched: DataFrame) -> DataFrame:
    """Source rows of sightings and fetches, folded by key, with their ids."""
    a = seen.select("url", "url_key", "title", F.col("captured_at").alias("at"))
    b = fetched.select("url", "url_key", "title", F.col("attempted_at").alias("at"))
    rows = a.union(b).select(
        "url", "url_key", domain_of(F.col("url_key")).alias("domain"), "title", doi_of(F.col("url")).alias("doi"), F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at")
    ).withColumn("kind", source_kind(F.col("domain"), F.col("doi")))
    return merge.fold_sources(rows).withColumn("source_id", hash63(F.col("url_key")))


def keyed_fetches(records: DataFrame) -> DataFrame:
    """Fetch records with url_key, source_id and document_id, published flattened.

    Records whose URL has no key are left out; ``fetch_url`` defaults to ``url``.
    """
    f = records.withColumn("url_key", url_key(F.col("url"))).where("url_key is not null")
    f = f.withColumn("source_id", hash63(F.col("url_key"))).withColumn("fetch_url", F.coalesce(F.nullif("fetch_url", F.lit("")), "url"))
    doc = F.when(F.coalesce("text_sha256", F.lit("")) != "", joined_id("document", F.col("url_key"), F.col("text_sha256")))
    return f.select(
        "*", doc.alias("document_id"), F.col("published.date").alias("pub"), F.col("published.precision").alias("published_precision"), F.col("published.from").alias("published_from"), F.col("published.weak").alias("published_weak")
    ).drop("published").withColumnRenamed("pub", "published").dropDuplicates(["run_id", "seq"])


def passages_of_documents(documents: DataFrame, texts: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """Passages of documents that have none yet, with content-derived ids."""
    todo = documents if have is None else documents.join(have.select("document_id").distinct(), "document_id", "left_anti")
    t = todo.join(texts, todo["text_sha256"] == texts["sha256"]).select("document_id", F.explode(passages_of(F.col("text"))).alias("p"))
    return t.select(
        joined_id("passage", F.col("document_id"), F.col("p.char_start"), F.col("p.char_end")).alias("passage_id"), "document_id", "p.ord", "p.char_start", "p.char_end", "p.text", F.sha2("p.text", 256).alias("text_sha256")
    )


def report_documents(runs: DataFrame, texts: DataFrame, prefix: str = "report:run/") -> tuple[DataFrame, DataFrame]:
    """Sources and documents of the runs' reports: syntheses, dated by their run's end.

    A run with a report whose text the store has becomes a source of its own
    (kind report, key ``prefix`` and the run) and a document of origin
    ``synthesis``, published the day the run ended (or began).  Returns
    ``(sources, documents)``; ``documents`` has ``run_id`` beside what
    ``fold_documents`` gives.
    """
    r = runs.where("coalesce(report_sha256, '') != ''").join(texts, F.col("report_sha256") == F.col("sha256"))
    r = r.select(F.col("id").alias("run_id"), F.concat(F.lit(prefix), "id").alias("url_key"), F.col("topic").alias("title"), F.coalesce("finished_at", "started_at").alias("at"), "sha256", F.length("text").alias("text_chars"))
    r = r.withColumn("source_id", hash63(F.col("url_key")))
    sources = r.select(
        F.col("url_key").alias("url"), "url_key", F.lit("report").alias("domain"), "title", F.lit("report").alias("kind"), F.lit(None).cast("string").alias("doi"), F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), "source_id"
    )
    documents = r.select(
        joined_id("document", F.col("url_key"), F.col("sha256")).alias("document_id"), "source_id", F.lit("full").alias("content_kind"), F.lit("text/markdown").alias("content_type"), "title", "text_chars", F.col("sha256").alias("text_sha256"),
        F.col("at").alias("first_fetched_at"), F.col("at").alias("last_fetched_at"), F.date_format("at", "yyyy-MM-dd").alias("published"), F.lit("day").alias("published_precision"), F.lit("run").alias("published_from"), F.lit(False).alias("published_weak"),
        F.lit("synthesis").alias("origin"), "run_id",
    )
    return sources, documents


def citations_of(lines: DataFrame) -> DataFrame:
    """Citations of the runs' ``citations.jsonl``, which a check rewrites whole: the first line of each (run, ord)."""
    first = lines.groupBy("run_id", "ord").agg(F.min_by(F.struct(*[c for c in lines.columns if c not in ("run_id", "ord", "line_no")]), "line_no").alias("x"))
    return first.select("run_id", "ord", "x.*").withColumn("quote_status", F.nullif("quote_status", F.lit("")))


def claims_of(extracted: DataFrame, documents: DataFrame, texts: DataFrame, passages: DataFrame) -> DataFrame:
    """Claims of extraction files, anchored in every document of their text.

    A claim's ordinal counts its chunk's claims, blank ones too, which are then
    left out, so ids stay when others change.
    """
    docs = documents.select("document_id", "text_sha256")
    c = extracted.select("text_sha256", "extractor", "extracted_at", F.posexplode("claims").alias("pos", "c"))
    w = Window.partitionBy("text_sha256", "extractor", "c.chunk").orderBy("pos")
    c = c.withColumn("ord", F.row_number().over(w) - 1).where(F.trim(F.coalesce("c.text", F.lit(""))) != "")
    c = c.join(docs, "text_sha256").join(texts.withColumnRenamed("sha256", "text_sha256").withColumnRenamed("text", "body"), "text_sha256")
    c = c.withColumn("at", locate_quote(F.col("c.quote"), F.col("body"))).select(
        joined_id("claim", F.col("document_id"), F.col("extractor"), F.col("c.chunk"), F.col("ord")).alias("claim_id"), "document_id", "extractor", F.col("c.chunk").alias("chunk"), "ord", F.col("c.text").alias("text"), F.col("c.quote").alias("quote"),
        F.col("at.char_start").isNotNull().alias("quote_verified"), F.col("at.char_start").alias("char_start"), F.col("at.char_end").alias("char_end"), F.when(F.col("at.char_start").isNotNull(), quote_key(F.col("c.quote"))).alias("quote_key"),
        F.when(date_of(F.col("c.as_of")).isNotNull(), F.trim("c.as_of")).alias("as_of"), precision_of(F.col("c.as_of")).alias("as_of_precision"), F.coalesce("c.volatile", F.lit(False)).alias("volatile"), "extracted_at",
    )
    spans = passages.select("document_id", "passage_id", "ord", F.col("char_start").alias("start"), F.col("char_end").alias("stop"))
    return joins.point_in_span(c, spans, ["document_id"], "char_start", "start", "stop", "ord").withColumnRenamed("span_passage_id", "passage_id").drop("span_start", "span_stop", "span_ord")


def synced_claims(known: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims after a new extraction of some documents, and the ids that went away.

    ``extracted`` replaces all claims of its (document, extractor) pairs in
    ``known``; claims of other pairs stay.
    """
    pairs = extracted.select("document_id", "extractor").distinct()
    old = known.join(pairs, ["document_id", "extractor"], "left_semi")
    kept = known.join(pairs, ["document_id", "extractor"], "left_anti").unionByName(extracted)
    return kept, old.select("claim_id").join(extracted.select("claim_id"), "claim_id", "left_anti")


def ingest(spark: SparkSession, store: str, only: list[str] | None = None) -> dict[str, DataFrame]:
    """All tables of a store's files, or of some of its runs.

    Runs that cannot be read cost their rows, not the job; reading the same
    files again gives the same ids and rows.  Reports are documents of origin
    ``synthesis``, with passages of their own.
    """
    some = lambda df: df.where(F.col("run_id").isin(only)) if only is not None else df
    captures = some(files.records(files.log_lines(spark, f"{store}/runs/*/captures.jsonl", files.CAPTURE)))
    fetched = keyed_fetches(some(files.records(files.log_lines(spark, f"{store}/runs/*/fetches.jsonl", files.FETCH))))
    seen = sightings(captures)
    texts = files.texts(spark, store)
    runs = files.run_records(spark, store)
    runs = runs.where(F.col("id").isin(only)) if only is not None else runs
    reports, syntheses = report_documents(runs, texts)
    primary = merge.fold_documents(fetched).withColumn("origin", F.lit("primary")).withColumn("run_id", F.lit(None).cast("string"))
    documents = primary.unionByName(syntheses)
    passages = passages_of_documents(documents, texts)
    citations = citations_of(files.records(some(files.log_lines(spark, f"{store}/runs/*/citations.jsonl", files.CITATION))))
    return {
        "runs": runs, "citations": citations, "captures": captures, "sources": sources_of(seen, fetched).unionByName(reports), "sightings": seen.withColumn("source_id", hash63(F.col("url_key"))), "fetches": fetched, "documents": documents, "passages": passages,
    }


def pending(spark: SparkSession, store: str, known: DataFrame) -> DataFrame:
    """Runs that are new or whose files changed since ``known`` fingerprints."""
    prints = ["record_sha256", "capture_bytes", "fetch_bytes", "citation_bytes"]
    return merge.changed(known, files.fingerprints(spark, store), "run_id", prints)
