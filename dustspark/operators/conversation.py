"""Chat context and call re-use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustspark import constants as C


def recent_turns(chat: DataFrame, turns: int = 6, chars: int = C.TURN_CHARS) -> DataFrame:
    """The last ``turns`` turns of each conversation, *then* only user and assistant turns with content.

    The rank filter also runs before the exchange, so a long conversation ships few rows per task.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = chat.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= turns)
    said = F.col("role").isin("user", "assistant") & (F.length("content") > 0)
    return last.filter(said).select("conv_id", "turn", "role", F.left("content", F.lit(chars)).alias("content"))


def first_calls(calls: DataFrame) -> DataFrame:
    """Identical (name, args) calls: the first one, and how many re-use it. Pre-aggregated per task."""
    return calls.groupBy("name", "args").agg(
        F.min("call_id").alias("call_id"), (F.count(F.lit(1)) - 1).alias("reused"))
