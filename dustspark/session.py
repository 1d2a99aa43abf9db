"""Session defaults and the two helpers that need to know about the cluster."""

from __future__ import annotations

import itertools
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BROADCAST_ROW_LIMIT = 200_000


def build_session(app: str = "dustspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _own_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder for a local session; on a cluster each executor would write to its own disk."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared checkpoint folder and continue from there.

    The folder is the cluster's ``spark.checkpoint.dir``; only when that is unset (tests) a
    temporary one is made. The data survives the loss of any executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(folder or _own_folder(spark, "dustspark-ckpt-"))
    return df.checkpoint(eager=True)


_FOLDERS = itertools.count()


def scratch(spark: SparkSession) -> str:
    """A fresh folder: under the cluster's checkpoint folder, or a local temporary one when that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/dustspark-{spark.sparkContext.applicationId}-{next(_FOLDERS)}"
    return _own_folder(spark, "dustspark-")


def written(df: DataFrame) -> DataFrame:
    """The frame as Parquet in a fresh shared folder: for frames that several reports read. Unlike a checkpoint, whose
    plan keeps all that can be derived of its columns' equalities, it costs nothing to plan for wide frames."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def send_code(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per Spark context, so that their functions can import it."""
    context = spark.sparkContext
    if not getattr(context, "_dustspark_sent", False):
        root = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='dustspark-code-')}/dustspark-code", "zip", root.parent, root.name))
        context._dustspark_sent = True


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before work which is heavy per row (text).

    A table of many files or row groups has splits enough and is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> bool:
    """True when the frame has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit
