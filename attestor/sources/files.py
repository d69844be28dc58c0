"""Files of the evidence store: JSON logs, run records, texts, vectors, Markdown.

Logs are append-only JSON lines whose last line may be cut off; they are read
whole per file and numbered, so that a bad line costs one row and its number
is known.  Files spread over tasks; one log is one row of at most what a run
wrote.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestor.functions.arrow import arrow_udf

# The store's schemas.
PUBLISHED = "struct<date:string,precision:string,from:string,weak:boolean>"
RUN = (
    "id string, kind string, topic string, backend string, mode string, branch_count int, sources array<string>, status string, error string, pid bigint, host string, "
    "started_at timestamp, finished_at timestamp, report_path string, report_sha256 string, captures int, files array<string>, metadata string"
)
CAPTURE = (
    "seq bigint, captured_at timestamp, worker int, shard string, backend string, model string, tool string, action string, query string, url string, "
    "results array<struct<rank:int,opened:boolean,title:string,url:string,snippet:string,ref_id:string>>, label string, content string"
)
FETCH = (
    "seq bigint, url string, fetch_url string, reason string, rank int, via string, attempted_at timestamp, attempts int, duration_ms bigint, http_status int, final_url string, "
    f"content_type string, error string, raw_sha256 string, raw_bytes bigint, text_sha256 string, text_chars int, content_kind string, title string, doi string, published {PUBLISHED}"
)
CITATION = "ord int, marker string, target_kind string, target_id string, report_offset int, group_ord int, quote string, resolved boolean, quote_status string, note string"
EXTRACTION = (
    "text_sha256 string, extractor string, model string, extracted_at timestamp, duration_ms bigint, chunks int, "
    "claims array<struct<text:string,quote:string,as_of:string,volatile:boolean,chunk:int>>, failed array<struct<chunk:int,error:string>>, attempts int"
)
LINK = "from_claim bigint, to_claim bigint, relation string, method string, model string, confidence float, note string, created_at timestamp"

RUN_NAME = r"/runs/([A-Za-z0-9][A-Za-z0-9._-]*)/"


def _fields(schema: str) -> str:
    """A table schema as the fields of a struct."""
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields)


def log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``run_id, line_no, line, record, state`` of each line of the logs at a path.

    ``state`` is ok, bad (complete but not decodable) or partial (a last line
    without newline: not decoded).  Blank lines are left out but numbered, from
    1.  ``run_id`` comes from the folder name (null elsewhere).  A path that
    matches nothing has no lines.
    """
    if listing(spark, path).isEmpty():
        return spark.createDataFrame([], f"run_id string, line_no int, line string, record struct<{_fields(schema)},_corrupt:string>, state string")
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    parts = F.split("value", "\n")
    last = F.size(parts) - 1
    rows = files.select("file", last.alias("last"), F.posexplode(parts).alias("pos", "line")).where(F.trim("line") != "")
    corrupt = f"{schema}, _corrupt string"
    record = F.from_json("line", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    state = F.when(F.col("pos") == F.col("last"), "partial").when(F.col("rec").isNull() | F.col("rec._corrupt").isNotNull(), "bad").otherwise("ok")
    rows = rows.withColumn("rec", record).withColumn("state", state)
    return rows.select(
        F.nullif(F.regexp_extract("file", RUN_NAME, 1), F.lit("")).alias("run_id"), (F.col("pos") + 1).alias("line_no"), "line", F.when(F.col("state") == "ok", F.col("rec")).alias("record"), "state"
    )


def tail_lines(spark: SparkSession, path: str, schema: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What logs have grown by since ``seen`` (path, offset), and the offsets to go on from.

    ``(path, line, record)`` of the whole lines behind each file's offset, null
    records for undecodable ones; a last line without newline waits for its
    end, and a file shorter than its offset is read anew.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    old = seen.select("path", "offset") if seen is not None else spark.createDataFrame([], "path string, offset bigint")
    at = F.coalesce("offset", F.lit(0))
    rest = files.join(F.broadcast(old), "path", "left").withColumn("offset", F.when(at > F.col("length"), 0).otherwise(at))
    rest = rest.withColumn("text", F.expr("decode(substring(content, cast(offset as int) + 1), 'UTF-8')"))
    whole = F.regexp_extract("text", r"(?s)^(.*\n)?", 0)
    rest = rest.withColumn("whole", whole)
    lines = rest.select("path", F.explode(F.split("whole", "\n")).alias("line")).where(F.trim("line") != "")
    offsets = rest.select("path", (F.col("offset") + F.octet_length("whole")).alias("offset"))
    return lines.select("path", "line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("record")), offsets


def records(lines: DataFrame, strict: bool = False) -> DataFrame:
    """The decoded records of ``log_lines``; strict: a bad line fails the job."""
    if strict:
        check = F.when(F.col("state") == "bad", F.raise_error(F.concat(F.lit("undecodable line "), F.col("line_no").cast("string")))).otherwise(F.lit(True))
        lines = lines.where(check)
    return lines.where("state = 'ok'").select("run_id", "line_no", "record.*").drop("_corrupt")


def log_problems(lines: DataFrame) -> DataFrame:
    """Per run the numbers of bad lines and whether the log is cut off."""
    return lines.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("state") == "bad", F.col("line_no")))).alias("bad_lines"), F.bool_or(F.col("state") == "partial").alias("partial"), F.count_if(F.col("state") == "ok").alias("records")
    )


def run_records(spark: SparkSession, store: str) -> DataFrame:
    """One row per ``runs/<id>/run.json``; metadata stays JSON text."""
    return spark.read.schema(RUN).option("multiLine", True).json(f"{store}/runs/*/run.json")


def listing(spark: SparkSession, pattern: str) -> DataFrame:
    """``(path, bytes, folder)`` of what a pattern matches in any file system Spark knows, empty files too.

    Names and sizes only: the listing that any reader makes on the driver.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    rows = [(str(f.getPath().toString()), int(f.getLen()), bool(f.isDirectory())) for f in found or ()]
    return spark.createDataFrame(rows, "path string, bytes bigint, folder boolean")


def fingerprints(spark: SparkSession, store: str) -> DataFrame:
    """Per run the record's hash and the logs' sizes (-1: no such file), for change detection."""
    logs = {"captures.jsonl": "capture_bytes", "fetches.jsonl": "fetch_bytes", "citations.jsonl": "citation_bytes"}
    own = F.regexp_extract("path", r"/runs/([^/]+)/[^/]+$", 1).alias("run_id")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    sizes = listing(spark, f"{store}/runs/*/*.jsonl").groupBy(own).agg(*[F.max(F.when(name == file, F.col("bytes"))).alias(c) for file, c in logs.items()])
    record = spark.read.format("binaryFile").load(f"{store}/runs/*/run.json").select(own, F.sha2("content", 256).alias("record_sha256"))
    return record.join(sizes, "run_id", "left").select("run_id", "record_sha256", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in logs.values()])


def extractions(spark: SparkSession, store: str) -> DataFrame:
    """Extraction files ``claims/<extractor>/<ab>/<sha>.json`` with path, size and completeness."""
    e = spark.read.schema(EXTRACTION).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{store}/claims")
    e = e.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_bytes"))
    named = e.where(F.regexp_extract("file", r"([^/]+)\.json$", 1).rlike("^[0-9a-f]{64}$"))
    return named.withColumn("complete", F.size(F.coalesce("failed", F.array().cast("array<struct<chunk:int,error:string>>"))) == 0)


def texts(spark: SparkSession, store: str) -> DataFrame:
    """``(sha256, text)`` of the content-addressed text store; names that are no hash are left out."""
    t = spark.read.text(f"{store}/text", wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return t.select(F.regexp_extract("_metadata.file_path", r"([0-9a-f]{64})\.txt$", 1).alias("sha256"), F.col("value").alias("text")).where("sha256 != ''")


@arrow_udf("array<float>")
def decode_vector(content: pd.Series) -> pd.Series:
    """Little-endian float32 bytes; null for empty or cut-off ones."""
    import numpy as np

    return content.map(lambda b: np.frombuffer(b, "<f4") if b and len(b) % 4 == 0 else None)


def vectors(spark: SparkSession, store: str) -> DataFrame:
    """``(model, text_sha256, embedding)`` of the vector cache."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.f32").load(f"{store}/vectors")
    part = lambda i: F.regexp_extract("path", r"/vectors/([^/]+)/[^/]+/([0-9a-f]{64})\.f32$", i)
    return f.select(part(1).alias("model"), part(2).alias("text_sha256"), decode_vector(F.col("content")).alias("embedding")).where("embedding is not null")


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """``category, name, path, modified, bytes`` of ``<category>/*.md``, by category and name."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{folder}/*").select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    f = f.withColumn("category", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return f.where(~F.col("category").startswith(".")).select("category", "name", "path", "modified", "bytes").orderBy("category", "name")


def line_range(text: Column, start: int = 1, end: int | None = None, most: int = 100_000) -> Column:
    """Lines ``start`` to ``end`` (from 1, inclusive) of a text, cut after ``most`` characters."""
    lines = F.split(text, "\n")
    n = F.lit(end) - F.lit(start) + 1 if end else F.size(lines)
    return F.substring(F.array_join(F.slice(lines, start, F.greatest(n, F.lit(0)).cast("int")), "\n"), 1, most)


def last_rows(spark: SparkSession, path: str, keys: list[str], columns: list[str]) -> DataFrame:
    """A tab-separated log where a later row of a key replaces an earlier one."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("line != ''")
    cells = F.split("line", "\t")
    rows = lines.where(F.size(cells) >= len(columns)).select("pos", *[cells.getItem(i).alias(c) for i, c in enumerate(columns)])
    rest = [c for c in columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("x")).select(*keys, "x.*")


def workspaces(text: str) -> dict[str, str]:
    """``workspace/project`` -> path of a small registry in JSON or simple YAML (read on the driver)."""
    if text.lstrip().startswith("{"):
        raw = json.loads(text).get("workspaces", {})
        return {f"{w}/{p['name']}": p["path"] for w, x in raw.items() for p in x.get("projects", [])}
    out, workspace, name = {}, "", ""
    for line in text.split("\n"):
        if m := re.match(r"^  (\w[\w-]*):\s*$", line):
            workspace = m[1]
        elif m := re.match(r"^\s*-?\s*name:\s*(\S+)", line):
            name = m[1]
        elif (m := re.match(r"^\s*-?\s*path:\s*(\S+)", line)) and name:
            out[f"{workspace}/{name}"] = m[1]
    return out


def existing_runs(spark: SparkSession, store: str) -> list[str]:
    """Names of run folders, empty ones too, in order (a listing on the driver)."""
    names = listing(spark, f"{store}/runs/*").where("folder").select(F.regexp_extract("path", r"([^/]+)/?$", 1).alias("n"))
    return sorted(r.n for r in names.where(F.col("n").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$")).collect())


@arrow_udf("binary")
def unzipped(content: pd.Series) -> pd.Series:
    """Bytes of a gzip file; null for what is none."""
    import gzip

    def read(b: bytes | None) -> bytes | None:
        try:
            return gzip.decompress(b) if b is not None else None
        except (OSError, EOFError, ValueError):
            return None

    return content.map(read)


def blobs(spark: SparkSession, store: str) -> DataFrame:
    """``(sha256, content)`` of the raw blob store ``blobs/<ab>/<sha>.gz``; what cannot be unzipped has a null content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.gz").load(f"{store}/blobs")
    return f.select(F.regexp_extract("path", r"([0-9a-f]{64})\.gz$", 1).alias("sha256"), unzipped(F.col("content")).alias("content")).where("sha256 != ''")


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file in a folder that all executors see, read by ranges of row ids in ``parts`` tasks.

    ``schema`` names the columns to read; values come as SQLite has them.
    """
    columns = [f.name for f in StructType.fromDDL(schema).fields]
    quoted = ", ".join(f'"{c}"' for c in columns)

    def ask(sql: str, *values) -> list[tuple]:
        import sqlite3

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            return db.execute(sql, values).fetchall()

    low, high = ask(f'select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from "{name}"')[0]
    step = max(1, -(-(high - low + 1) // parts))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in b["id"]:
                yield pd.DataFrame(ask(f'select {quoted} from "{name}" where rowid >= ? and rowid < ?', int(start), int(start) + step), columns=columns, dtype=object)

    return spark.range(low, high + 1, step, parts).mapInPandas(read, schema)
