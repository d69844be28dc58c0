"""Writers: sequence-numbered appends, keyed overwrites, validated links, swaps."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestor.operators.merge import valid_links


def numbered(new: DataFrame, last: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new`` with ``seq`` continuing after each key's largest in ``last`` (key, seq)."""
    top = last.groupBy(key).agg(F.max("seq").alias("_top"))
    w = Window.partitionBy(key).orderBy(*order)
    return new.join(top, key, "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + F.row_number().over(w)).drop("_top")


def append_links(links: DataFrame, path: str) -> None:
    """Append the valid links of a batch as JSON lines; rule links are never logged."""
    valid_links(links).write.mode("append").json(path)


def put_texts(texts: DataFrame, path: str) -> None:
    """Add texts that the store does not have yet, keyed by content hash."""
    new = texts.where("text is not null").select(F.sha2("text", 256).alias("sha256"), "text").dropDuplicates(["sha256"])
    spark = texts.sparkSession
    if _exists(spark, path):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, key: str) -> None:
    """Overwrite only the partitions of ``key`` that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


POINTER = "_CURRENT"  # a table's file that names the folder of its rows


def swap(df: DataFrame, path: str, keep: int = 1) -> None:
    """Rebuild a table: its rows are written to a folder of their own, then one file is set to name it.

    Readers (``current``) see the old rows or the new ones, never neither; a
    crash before the last step leaves the old table.  The ``keep`` folders
    before stay for readers still at them.
    """
    spark = df.sparkSession
    name = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{name}")
    set_pointer(spark, path, name)
    to, fs = _hadoop(spark, path)
    old = sorted(f.getPath().getName() for f in fs.listStatus(to(path)) if f.isDirectory() and f.getPath().getName() < name)
    for x in old[: len(old) - keep]:
        fs.delete(to(f"{path}/{x}"), True)


def set_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Set a table's pointer in one step: written aside, then renamed over the old one."""
    to, fs = _hadoop(spark, path)
    out = fs.create(to(f"{path}/{POINTER}.new"), True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(options, 1)
    over[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to(path).toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    context.rename(to(f"{path}/{POINTER}.new"), to(f"{path}/{POINTER}"), over)


def pointer(spark: SparkSession, path: str) -> str | None:
    """What a table's pointer says; None where there is none."""
    to, fs = _hadoop(spark, path)
    if not fs.exists(to(f"{path}/{POINTER}")):
        return None
    stream = fs.open(to(f"{path}/{POINTER}"))
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table written by ``swap``; None where there is none."""
    name = pointer(spark, path)
    return spark.read.parquet(f"{path}/{name}") if name else None


def _hadoop(spark: SparkSession, path: str):
    to = spark._jvm.org.apache.hadoop.fs.Path
    return to, to(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    to, fs = _hadoop(spark, path)
    return fs.exists(to(path))


def write_sheet(rows: DataFrame, path: str) -> None:
    """Measures as tab-separated text with a header, in one file where the result is small (a report's table)."""
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
