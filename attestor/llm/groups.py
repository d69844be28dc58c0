"""Groups from pairwise matches: connected components by seed-tree pruning.

Each round, every vertex announces the smallest id of its neighbourhood to all
of that neighbourhood; vertices that nobody chose as a minimum leave the graph
and hang below the minimum they saw (the propagation forest), the rest are
linked to their own minimum.  The graph shrinks quickly - chains by about half
per round, stars at once - and no vertex ever gathers its group in one task.
When no edge is left, the seed ids flow down the forest, one round's layer at
a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import Scratch


def connected_groups(pairs: DataFrame, left: str, right: str, space: str | None = None, max_rounds: int = 60, hub: int = 100_000) -> DataFrame:
    """``(space, group_id, record_id)`` for every id that occurs in a pair of two ids.

    ``group_id`` is the smallest id of the group, whose own row is included.
    Ids of different values of the column ``space`` are different records (null
    is a value of its own, without the column there is one space and no such
    column in the result).  Direction, repeats, self pairs and pairs with a
    null end do not matter (self pairs and null ends join nothing and give no
    row); other columns of ``pairs`` are ignored.  An empty input gives an
    empty result.  Vertices of ``hub`` edges or more (there can be few: the
    edges over ``hub``) learn and tell their minimum by a broadcast of their
    rows, so their edges stay where they lie.  A graph of ``max_rounds`` rounds
    (chains halve in each) is an error.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    kind = F.coalesce(F.concat(F.lit("="), F.col(space).cast("string")), F.lit("")) if space else F.lit("")
    p = pairs.select(kind.alias("k"), F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    p = p.where(F.col("u") != F.col("v"))
    start = graph = scratch.save(_both_ways(p))
    layers: list[DataFrame] = []
    while (widest := _widest(graph)) > 0:
        if len(layers) == max_rounds:
            raise RuntimeError("seed-tree pruning did not converge")
        minimum = graph.groupBy("k", "u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        told = _at_hubs(graph, minimum, ["k", "u"], widest, hub).select("k", F.col("v").alias("x"), F.col("m").alias("y"))
        told = scratch.save(told.union(minimum.select("k", F.col("u").alias("x"), F.col("m").alias("y"))).distinct())
        seen = scratch.save(told.groupBy("k", "x").agg(F.min("y").alias("parent"), F.max(F.col("x") == F.col("y")).alias("chosen"), F.count("*").alias("n")))
        layers.append(seen.where(~F.col("chosen")).select("k", F.col("x").alias("record_id"), "parent"))
        links = _at_hubs(told, seen.select("k", "x", "parent", "n"), ["k", "x"], widest + 1, hub).where(F.col("y") != F.col("parent"))
        following = scratch.save(_both_ways(links.select("k", F.col("parent").alias("u"), F.col("y").alias("v"))))
        scratch.drop(told, *([] if graph is start else [graph]))
        graph = following
    # whoever never left the graph is the seed of its group
    labelled = start.select("k", F.col("u").alias("record_id")).distinct()
    if layers:
        left = layers[0].select("k", "record_id")
        for layer in layers[1:]:
            left = left.union(layer.select("k", "record_id"))
        labelled = labelled.join(left, ["k", "record_id"], "left_anti")
    labelled = scratch.save(labelled.select("k", F.col("record_id").alias("group_id"), "record_id"))
    for layer in reversed(layers):
        down = layer.join(labelled.select("k", "group_id", F.col("record_id").alias("parent")), ["k", "parent"])
        labelled = labelled.union(scratch.save(down.select("k", "group_id", "record_id")))
    if not space:
        return labelled.select("group_id", "record_id")
    back = F.when(F.col("k") != "", F.substring("k", 2, 2**31 - 1)).cast(pairs.schema[space].dataType)
    return labelled.select(back.alias(space), "group_id", "record_id")


def _widest(graph: DataFrame) -> int:
    """Edges of the widest vertex; 0 without an edge."""
    return graph.groupBy("k", "u").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _at_hubs(edges: DataFrame, vertices: DataFrame, keys: list[str], widest: int, hub: int) -> DataFrame:
    """``edges`` joined with their vertices' rows (which have ``n``, their number of edges); hubs' rows are broadcast."""
    if widest < hub:
        return edges.join(vertices, keys)
    wide = F.broadcast(vertices.where(F.col("n") >= hub))
    rest = edges.join(wide.select(*keys), keys, "left_anti").join(vertices.where(F.col("n") < hub), keys)
    return edges.join(wide, keys).unionByName(rest)


def _both_ways(edges: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select("k", both.alias("e")).select("k", "e.u", "e.v").distinct()


METHODS = {"human": 3, "model": 2, "rule": 1}


def holding_links(claims: DataFrame, links: DataFrame) -> DataFrame:
    """The link that holds per unordered pair of claims that both exist.

    A human's link beats a model's, a model's a rule's; within a method the
    latest ``created_at`` wins (null counts as earliest; a tie goes to the
    smaller ``from_claim``, then to the relation first by name).  Links of a
    claim to itself, with a null end or with an unknown method count for
    nothing.  Returns ``(a, b, relation)`` with ``a < b``.
    """
    known = claims.select(F.col("claim_id").alias("id")).where("id is not null").distinct()
    rank = F.coalesce(*[F.when(F.col("method") == m, F.lit(r)) for m, r in METHODS.items()])
    pair = links.where("from_claim != to_claim").select(
        F.least("from_claim", "to_claim").alias("a"),
        F.greatest("from_claim", "to_claim").alias("b"),
        F.struct(rank.alias("rank"), "created_at", (-F.col("from_claim")).alias("first"), F.col("relation").alias("r")).alias("order"),
        "relation",
    ).where("order.rank is not null")
    # claims' copies and many lines per pair collapse map-side before the semi joins
    held = pair.groupBy("a", "b").agg(F.max_by("relation", "order").alias("relation"))
    return (
        held.join(known.withColumnRenamed("id", "a"), "a", "left_semi")
        .join(known.withColumnRenamed("id", "b"), "b", "left_semi")
        .select("a", "b", "relation")
    )


def match_groups(claims: DataFrame, links: DataFrame, origins: DataFrame) -> DataFrame:
    """``(record_kind, group_id, record_id)`` of claims and of documents.

    Claims join by pairs whose holding link is ``same``; documents by rows of
    ``origins`` whose two ids differ.
    """
    same = holding_links(claims, links).where("relation = 'same'")
    pairs = same.select(F.lit("claim").alias("record_kind"), "a", "b").union(
        origins.select(F.lit("document").alias("record_kind"), "document_id", "origin_id")
    )
    return connected_groups(pairs, "a", "b", space="record_kind")
