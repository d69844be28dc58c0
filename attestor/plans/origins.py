"""Independent origins: which documents repeat which."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions.identity import url_key
from attestor.functions.text import piece_grams, seam_grams, simhash, simhash_of_sums
from attestor.operators.components import staged_groups
from attestor.operators.joins import hash_pairs
from attestor.plans.claims import claim_relations
from attestor.session import Scratch, spread

NEAR_CHARS = 1_000  # shorter texts are not compared by SimHash


def star(df: DataFrame, key: str) -> DataFrame:
    """Edges ``(a, b)`` from the smallest document of a key to its others; null keys join nothing."""
    rows = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(F.col(key).alias("k"), "document_id").distinct()
    head = rows.groupBy("k").agg(F.min("document_id").alias("a"))
    return rows.join(head, "k").where("document_id != a").select("a", F.col("document_id").alias("b"))


def same_claims(claims: DataFrame, links: DataFrame, at_least: int = 2) -> DataFrame:
    """Document pairs that two or more pairs of claims call the same."""
    doc = claims.dropDuplicates(["claim_id"]).select("claim_id", "document_id")
    same = claim_relations(links).where("relation = 'same'")
    both = same.join(doc.select(F.col("claim_id").alias("a"), F.col("document_id").alias("d1")), "a").join(doc.select(F.col("claim_id").alias("b"), F.col("document_id").alias("d2")), "b")
    pair = both.where("d1 != d2").groupBy(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).agg(F.count("*").alias("n"))
    return pair.where(F.col("n") >= at_least).select("a", "b")


def _hashes(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, simhash)`` of the texts of NEAR_CHARS or more; hashed once, the pairs read them several times."""
    long = spread(texts.where(F.length(text_col) >= NEAR_CHARS).select(id_col, text_col))
    return Scratch(texts.sparkSession, "simhash").save(long.select(F.col(id_col), simhash(F.col(text_col)).alias("simhash")))


def document_hashes(passages: DataFrame) -> DataFrame:
    """``(document_id, simhash)`` of documents of NEAR_CHARS or more, from their passages as they lie.

    Shingles add up: each passage gives sums for 64 bits and its outer words,
    and only those meet by document.  The result is the SimHash of the passages
    set apart by blanks (a passage of one word hides the shingle across it).
    """
    read = spread(passages.select("passage_id", "document_id", "ord", "text")).select("passage_id", "document_id", "ord", F.length("text").alias("n"), piece_grams(F.col("text")).alias("g"))
    p = read.dropDuplicates(["passage_id"]).select("document_id", "ord", "n", "g.*")
    w = Window.partitionBy("document_id").orderBy("ord")
    p = p.withColumn("before", F.lag("tail").over(w)).withColumn("seam", seam_grams(F.col("before"), F.col("head")))
    bit = lambda i: F.expr(f"sum(sums[{i}] + seam[{i}]) as b{i}")
    sums = p.groupBy("document_id").agg((F.sum("n") + 2 * (F.count("*") - 1)).alias("n"), *[bit(i) for i in range(64)])
    return sums.where(F.col("n") >= NEAR_CHARS).select("document_id", simhash_of_sums([f"b{i}" for i in range(64)]).alias("simhash"))


def near_copies(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pairs of texts of NEAR_CHARS or more whose SimHashes differ in three bits at most.

    Equal hashes come as pairs with their smallest id; see ``hash_pairs``.
    """
    return hash_pairs(_hashes(texts, id_col, text_col), id_col, "simhash")


def near_links(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each text with a near copy: ``class_id``, ``first_near`` and the number of all its ``links``.

    A class is the texts of one SimHash, named by its smallest id.  Only
    classes meet; sizes and smallest ids of the near ones are summed, so
    copies are counted in full and their pairs never made.  Rows of one id and
    one hash count once.
    """
    hashes = _hashes(texts, id_col, text_col).where("simhash is not null").distinct()
    classes = hashes.groupBy("simhash").agg(F.min(id_col).alias("class_id"), F.count("*").alias("size"))
    second = hashes.join(classes, "simhash").where(F.col(id_col) != F.col("class_id")).groupBy("class_id").agg(F.min(id_col).alias("second"))
    pairs = hash_pairs(classes, "class_id", "simhash").select("a", "b")
    sizes = classes.select("class_id", "size")
    ends = pairs.union(pairs.select("b", "a")).toDF("class_id", "o").join(sizes.toDF("o", "o_size"), "o")
    near = ends.groupBy("class_id").agg(F.min("o").alias("near"), F.sum("o_size").alias("near_size"))
    whole = classes.join(second, "class_id", "left").join(near, "class_id", "left")
    own = F.when(F.col(id_col) == F.col("class_id"), F.col("second")).otherwise(F.col("class_id"))
    out = hashes.join(whole, "simhash").select(id_col, "class_id", F.least(own, F.col("near")).alias("first_near"), (F.col("size") - 1 + F.coalesce("near_size", F.lit(0))).alias("links"))
    return out.where("links > 0")


def origin_groups(fetches: DataFrame, claims: DataFrame, links: DataFrame, passages: DataFrame | None = None) -> DataFrame:
    """``(document_id, origin_id, reason)`` for every fetched document.

    Stages in order of certainty: one source, one final URL, one DOI, shared
    claims, near-duplicate texts (by their ``passages``).  The
    origin is the group's smallest document.
    """
    f = fetches.where("document_id is not null").select("document_id", "source_id", url_key(F.col("final_url")).alias("final_key"), F.lower("doi").alias("doi"))
    stages = [("source", star(f, "source_id")), ("final-url", star(f, "final_key")), ("doi", star(f, "doi")), ("same-link", same_claims(claims, links))]
    if passages is not None:
        hashes = Scratch(passages.sparkSession, "hashes").save(document_hashes(passages))
        stages.append(("near-duplicate", hash_pairs(hashes, "document_id", "simhash").select("a", "b")))
    out = staged_groups(f.select(F.col("document_id").alias("id")), stages)
    return out.select(F.col("id").alias("document_id"), F.col("root").alias("origin_id"), "reason")
