"""Session helpers: settings the library relies on, and lineage cutting."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "attestor", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries expect.

    On a cluster leave ``master`` unset: it comes from ``spark-submit``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the cluster's ``spark.checkpoint.dir``.  Only where that is unset, as
    in local tests, a temporary folder of this machine is taken; a session on a
    cluster without the setting is refused, because its executors would not see
    one another's files there.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="attestor-")
        atexit.register(shutil.rmtree, known, ignore_errors=True)
        context.setCheckpointDir(known)
        return known
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


_ROOTS: list[str] = []  # folders of intermediate tables that this process has made


def clean_scratch(spark: SparkSession) -> int:
    """Delete all intermediate tables that this process has made, once the results that read them are written; how many."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    count = len(_ROOTS)
    while _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


class Scratch:
    """Intermediate tables in the shared folder; they survive lost executors.

    ``save`` writes a table and reads it back (lineage is cut, the schema is
    known, and its size can be measured).  ``drop`` deletes tables no longer
    read.  What a returned DataFrame still reads stays until its owner has
    written the result and calls ``clean_scratch``; folders of this machine are
    deleted when Python ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._attestor_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._attestor_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def bytes(self, table: DataFrame) -> int:
        """Size of a saved table's files, for broadcast decisions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table._attestor_path)
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return int(fs.getContentSummary(path).getLength())


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per context."""
    context = spark.sparkContext
    if getattr(context, "_attestor_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="attestor-")) / "attestor.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))  # Spark's file server hands it to every executor
    context._attestor_shipped = True


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few input splits dealt out over all cores, for work that costs more than the move.

    A large table has more splits than cores and stays where it lies; so does
    what comes out of a shuffle, whose partitions Spark sizes itself.
    """
    plan = rows._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if plan.toRdd().getNumPartitions() >= cores else rows.repartition(cores)
