"""What the text operators share: word and line splitting, and values bound once inside an expression."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

import dustspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces; null or empty text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once per Spark context, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if not getattr(context, "_dustspark_sent", False):
        root = Path(dustspark.__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='dustspark-code-')}/dustspark-code", "zip", root.parent, root.name)
        context.addPyFile(archive)
        context._dustspark_sent = True
