"""Connected components by star contraction, and groups built up in stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.session import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """``(id, root)`` of every id in an edge of two ids; root is the smallest.

    Edges ``(a, b)``; direction, repeats, self edges and null ends do not
    matter.  Large-star and small-star steps alternate until nothing changes;
    a vertex's edges are aggregated, never gathered.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.save(e)
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v"))).distinct()
        following = scratch.save(small)
        now = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = following
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("star contraction did not converge")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def staged_groups(ids: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(id, root, reason)``: components of all stages' edges, built stage by stage.

    ``reason`` is the stage after which an id first was not its group's
    smallest, or ``self``.  Only roots meet in a later stage, so each works on
    what is left to join.
    """
    scratch = Scratch(ids.sparkSession, "origins")
    state = scratch.save(ids.select("id", F.col("id").alias("root"), F.lit("self").alias("reason")).distinct())
    for name, edges in stages:
        roots = state.select("id", "root")
        e = edges.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        e = scratch.save(e.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b").distinct())
        if e.isEmpty():
            continue
        moved = components(e, scratch).select(F.col("id").alias("root"), F.col("root").alias("new"))
        state = scratch.save(
            state.join(moved, "root", "left").select(
                "id",
                F.coalesce("new", "root").alias("root"),
                F.when((F.col("reason") == "self") & (F.coalesce("new", "root") != F.col("id")), F.lit(name)).otherwise(F.col("reason")).alias("reason"),
            )
        )
    return state
