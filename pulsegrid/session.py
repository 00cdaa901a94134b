"""Session helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a table of units, bins or chunks that may be broadcast.
BROADCAST_ROWS = 1_000_000


#: The limit of bytes of an Arrow batch, and what Spark sets it to.
BATCH_BYTES, DEFAULT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast only if a count shows that it has `rows` rows at most; else the join is Spark's choice."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each Spark context.

    Where the size of Arrow batches is as Spark sets it, it is lowered: rows here are whole documents, and a batch of
    10,000 of them takes tens of megabytes on both sides of each worker. Chunks of long series are larger yet, so
    batches have a limit of bytes too.
    """
    if spark.conf.get(BATCH_BYTES, None) in (None, DEFAULT_BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, "16777216")
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    sc = spark.sparkContext
    if getattr(sc, "_pulsegrid_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="pulsegrid-"), "pulsegrid.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("pulsegrid", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._pulsegrid_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets one of its own; on a cluster a machine-local folder would lose
    what executors write, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _remove(spark: SparkSession, folders: list[str]) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared one, deleted when the program ends (results may be read from it until then)."""
    folder = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    if not hasattr(sc, "_pulsegrid_folders"):
        sc._pulsegrid_folders = []
        atexit.register(_remove, spark, sc._pulsegrid_folders)
    sc._pulsegrid_folders.append(folder)
    return folder


def save(df: DataFrame) -> DataFrame:
    """df, written to a new folder under the shared one and read again: it cuts lineage and survives lost executors."""
    path = f"{work_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
