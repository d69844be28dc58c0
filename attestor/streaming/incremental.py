"""Streams over growing logs: the same folds as the batch plans, in whatever order rows come.

State is a table keyed as the batch result is; each micro-batch is folded in
with an order-free merge, so late rows, repeats and replays converge.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from attestor.operators.merge import fold_sources, latest_links, valid_links
from attestor.sources.sinks import pointer, set_pointer


def folded(stream: DataFrame, state: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], checkpoint: str, parts: int = 64, once: bool = True) -> StreamingQuery:
    """Fold a stream into the table at ``state``: state = fold(state + batch), by ``keys``.

    The state lies in ``parts`` parts by its keys' hash, and a batch rewrites
    those it touches and no others: their new rows go to a folder of their own,
    then one file is set that says where each part lies, so a crash leaves the
    old state.  ``fold`` must be idempotent and
    order-free; then a replayed batch changes nothing.  ``once`` works off what
    is there and ends.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        number = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
        new = fold(batch).persist()
        touched = [r.n for r in new.select(number.alias("n")).distinct().collect()]  # numbers below ``parts``
        if not touched:
            return
        where = json.loads(pointer(spark, state) or "{}")
        old = [f"{state}/{where[str(n)]}/state_part={n}" for n in touched if str(n) in where]
        rows = new
        if old:
            before = spark.read.parquet(*old)
            rows = fold(before.unionByName(new, allowMissingColumns=True).select(*before.columns))
        name = f"v{time.time_ns():020d}"
        rows.withColumn("state_part", number).write.partitionBy("state_part").parquet(f"{state}/{name}")
        set_pointer(spark, state, json.dumps(where | {str(n): name for n in touched}))
        new.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def state_of(spark: SparkSession, state: str) -> DataFrame | None:
    """All parts of a folded state; None where there is none."""
    where = json.loads(pointer(spark, state) or "{}")
    return spark.read.parquet(*[f"{state}/{name}/state_part={n}" for n, name in sorted(where.items())]) if where else None


def link_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Link lines as files arrive in a folder; invalid ones are left out."""
    return valid_links(spark.readStream.schema(schema).parquet(folder), ("rule", "model", "human"))


def sync_links(spark: SparkSession, folder: str, schema: StructType, state: str, checkpoint: str) -> StreamingQuery:
    """The link log folded to its newest lines, incrementally."""
    return folded(link_stream(spark, folder, schema), state, ["from_claim", "to_claim", "method"], latest_links, checkpoint)


def sync_sources(spark: SparkSession, folder: str, schema: StructType, state: str, checkpoint: str) -> StreamingQuery:
    """Sources folded by key, incrementally."""
    return folded(spark.readStream.schema(schema).parquet(folder), state, ["url_key"], fold_sources, checkpoint)


def event_windows(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums per type in event-time windows, late rows within a watermark."""
    w = F.window("ts", size)
    out = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "value")
