"""Session defaults and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEYS = ("series_id",)
SMALL = 1 << 16  # bytes of files that cannot hold many rows
MOST = 1 << 25  # bytes of rows in memory up to which the size of a table's files may decide on a broadcast
_SHIPPED: set[str] = set()
_SESSIONS: dict[tuple, JavaObject] = {}


def session(app: str = "tidegraph", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``. Only a session whose one process is driver and executor
    (``local[...]``) may leave the setting out and gets a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidegraph-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tidegraph-{sc.applicationId}"


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session whose workers do not find it themselves: neither the working
    folder nor PYTHONPATH holds it. Once a session."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if sc.applicationId in _SHIPPED or root in map(os.path.abspath, filter(None, known)):
        return
    _SHIPPED.add(sc.applicationId)
    packed = os.path.join(tempfile.mkdtemp(prefix="tidegraph-"), "tidegraph.zip")
    with zipfile.ZipFile(packed, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "tidegraph")):
            for name in names:
                if name.endswith(".py"):
                    out.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(packed)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder named by ``spark.checkpoint.dir`` and read it back.

    Survives lost executors and stops plans of iterative operators from growing. Unlike a
    checkpoint, which keeps the size estimate of the whole history (it multiplies at every
    join), a written table has the size of its files, so small sides are broadcast only when they
    are proven small; see ``sized`` for files that hold far more than their size. Only a local
    session without the setting gets a temporary folder.
    """
    ship(df.sparkSession)
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return sized(df.sparkSession.read.schema(df.schema).parquet(path), path)


def sized(table: DataFrame, path: str) -> DataFrame:
    """``table``, just read from the files at ``path``, planned with the size of its rows if these take more than ``MOST`` bytes and than the files.

    Files of sorted keys and small numbers are compressed a hundredfold and more: 6 million rows of (series, graph, node,
    label) are 1.6 MB, and a join that takes this for their size sends all of them through the driver. Rows are counted
    from the files' footers. Spark has the factor between files and rows in the session's settings only, so such a table
    is read by a copy of the session, one for each power of two.
    """
    files = table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if files < SMALL:
        return table
    rows = table.count() * (8 + table._jdf.schema().defaultSize())
    if rows <= max(MOST, files):
        return table
    spark, factor = table.sparkSession, 1 << (rows // files).bit_length()
    own = spark._jsparkSession
    at = (spark.sparkContext.applicationId, own.sessionUUID(), factor)
    if at not in _SESSIONS:
        _SESSIONS[at] = own.cloneSession()
        _SESSIONS[at].conf().set("spark.sql.sources.fileCompressionFactor", str(factor))
    read = _SESSIONS[at].read().schema(table._jdf.schema()).parquet(path)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own, read.logicalPlan()), spark)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, counted by the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]


def release(spark: SparkSession) -> None:
    """Delete the tables written by ``cut`` in this application, when no result needs them any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
