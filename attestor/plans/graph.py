"""The reference graph: citing counts, imports of bibliographies, report links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.functions.identity import url_key
from attestor.functions.markdown import extract_urls

# What nodes and edges may be.
NODE_TYPES = ("source", "claim", "report", "entity", "lead", "topic")
EDGE_TYPES = ("references", "supports", "contradicts", "refines", "mentions", "derived_from", "related")


def cited_by(edges: DataFrame, name: str = "to_id", count: str = "cited") -> DataFrame:
    """Distinct ``from_id`` of each ``to_id``; null ends count for nothing."""
    e = edges.where("from_id is not null and to_id is not null")
    return e.groupBy(F.col("to_id").alias(name)).agg(F.count_distinct("from_id").alias(count))


def cited_at_least(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    return nodes.join(cited_by(edges, "id"), "id").where(F.col("cited") >= least)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a known type between nodes that both exist."""
    ids = nodes.select("id")
    return edges.where(F.col("type").isin(*EDGE_TYPES)).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(edges.columns)


def import_sources(entries: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New source nodes, new references edges, and counters of an import.

    ``entries`` (book, pos, title, author, url, date, notes); ``nodes`` (id,
    key, title); ``edges`` (from_id, to_id).  Entries of one normalized URL
    are one source, the first names it; entries without a URL are skipped and
    those with another scheme are invalid.  Importing again creates nothing.
    """
    e = entries.withColumn("key", url_key(F.col("url")))
    one = e.where("key is not null").groupBy("key").agg(
        F.min_by("title", "pos").alias("title"), F.min_by("url", "pos").alias("url"), F.min("pos").alias("pos"), F.array_sort(F.collect_set("book")).alias("books"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct("pos", "notes")))), lambda x: x["notes"])), "; ").alias("notes"),
    )
    known = nodes.select("key", F.col("id").alias("known_id"))
    own = one.join(known, "key", "left").withColumn("id", F.coalesce("known_id", F.concat(F.lit("url:"), "key")))
    created = own.where("known_id is null").select("id", "key", "title", "url", "books", "notes")
    refs = e.where("key is not null").select(F.concat(F.lit("book:"), "book").alias("from_id"), "key").distinct().join(own.select("key", F.col("id").alias("to_id")), "key").select("from_id", "to_id")
    added = refs.join(edges.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    blank = F.trim(F.coalesce("url", F.lit(""))) == ""
    stats = e.agg(F.count("*").alias("entries"), F.count_if(blank).alias("skipped"), F.count_if(~blank & F.col("key").isNull()).alias("invalid"), F.count_distinct("key").alias("unique"))
    more = own.agg(F.count_if(F.col("known_id").isNull()).alias("created"), F.count_if(F.col("known_id").isNotNull()).alias("reused"))
    return created, added, stats.crossJoin(more).crossJoin(added.agg(F.count("*").alias("edges")))


def adopted_keys(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, node_id)`` for source nodes without a key whose URL gives one; the oldest node takes a key, known keys stay.

    ``nodes`` (id, type, url, created_at), ``keys`` (key, node_id).
    """
    bare = nodes.where("type = 'source'").join(keys.select(F.col("node_id").alias("id")), "id", "left_anti").select("id", "created_at", url_key(F.col("url")).alias("key"))
    one = bare.where("key is not null").groupBy("key").agg(F.min_by("id", F.struct("created_at", "id")).alias("node_id"))
    return one.join(keys.select("key"), "key", "left_anti").select("key", "node_id")


def described_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge from both of its ends: ``node_id, direction, type, other_id, other_title, other_type`` (null for a lost end)."""
    sides = F.array(
        F.struct(F.col("from_id").alias("node_id"), F.lit("outgoing").alias("direction"), F.col("to_id").alias("other_id")),
        F.struct(F.col("to_id").alias("node_id"), F.lit("incoming").alias("direction"), F.col("from_id").alias("other_id")),
    )
    both = edges.select("type", F.explode(sides).alias("s")).select("s.node_id", "s.direction", "type", "s.other_id")
    other = nodes.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"), F.col("type").alias("other_type"))
    return both.join(other, "other_id", "left").select("node_id", "direction", "type", "other_id", "other_title", "other_type")


def merged_metadata(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Source nodes with what books' entries say of them, and whether that changed anything.

    ``nodes`` (key, author, kind, date, books array<string>, notes
    map<string,array<string>>), ``entries`` (book, pos, url, author, type, date,
    notes).  Books are a sorted set; a book's notes are kept in order, new ones
    behind; author, kind and date are filled only where empty, from the first
    entry that has them.  Merging again changes nothing.
    """
    e = entries.withColumn("key", url_key(F.col("url"))).where("key is not null")
    filled = lambda c: F.min_by(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.trim(c)), F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct("book", "pos")))
    note = F.trim(F.coalesce("notes", F.lit("")))
    texts = e.where(note != "").groupBy("key", "book", note.alias("note")).agg(F.min("pos").alias("pos"))
    texts = texts.groupBy("key", "book").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "note"))), lambda x: x["note"]).alias("list"))  # a book's notes on one page
    texts = texts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("book", "list"))).alias("new_notes"))
    said = e.groupBy("key").agg(filled(F.col("author")).alias("a"), filled(F.col("type")).alias("t"), filled(F.col("date")).alias("d"), F.array_sort(F.collect_set("book")).alias("b")).join(texts, "key", "left")
    j = nodes.join(said, "key", "left")
    none = F.create_map().cast("map<string,array<string>>")
    old, new = F.coalesce("notes", none), F.coalesce("new_notes", none)
    notes = F.map_zip_with(old, new, lambda k, x, y: F.array_union(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>"))))
    keep = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(v))
    empty = F.array().cast("array<string>")
    books = F.array_sort(F.array_union(F.coalesce("books", empty), F.coalesce("b", empty)))
    entry = lambda m: F.array_sort(F.map_entries(m))
    changed = (F.size(books) != F.size(F.coalesce("books", empty))) | (entry(notes) != entry(old)) | ~keep("author", "a").eqNullSafe(F.nullif("author", F.lit(""))) | ~keep("kind", "t").eqNullSafe(F.nullif("kind", F.lit(""))) | ~keep("date", "d").eqNullSafe(F.nullif("date", F.lit("")))
    return j.select("key", keep("author", "a").alias("author"), keep("kind", "t").alias("kind"), keep("date", "d").alias("date"), books.alias("books"), notes.alias("notes"), changed.alias("changed"))


def link_report(report_id: str, prefix: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Missing ``references`` edges from a report to every other node under a path prefix."""
    under = nodes.where(F.col("path").startswith(prefix) & (F.col("id") != report_id)).select(F.lit(report_id).alias("from_id"), F.col("id").alias("to_id"))
    return under.join(edges.where("type = 'references'").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").withColumn("type", F.lit("references"))


def bibliography(documents: DataFrame) -> DataFrame:
    """``(key, url, cited)``: pages that documents' texts point to, by distinct documents."""
    urls = documents.where("text is not null").select("doc_id", F.explode(extract_urls(F.col("text"))).alias("url"))
    e = urls.withColumn("key", url_key(F.col("url"))).where("key is not null")
    return e.groupBy("key").agg(F.min("url").alias("url"), F.count_distinct("doc_id").alias("cited"))


def export_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Nodes and edges as JSON lines under a folder, each written in parallel."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")
