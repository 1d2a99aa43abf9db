"""Ordered folds over the bounded daily series of a site.

A site has one row per day, so its series is an array of at most some ten thousand small structs. The
fold walks it in blocks and joins the block outputs, which keeps array appends short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def fold(days: Column, start: Column, state_type: str, out_type: str,
         step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Run ``step(state, day) -> (state, out)`` over the array and return the array of outs.

    The step must return exactly the declared types.
    """
    acc_type = f"struct<s:{state_type},o:array<{out_type}>>"
    nothing = F.array().cast(f"array<{out_type}>")
    count = F.ceil(F.size(days) / BLOCK).cast("int")
    blocks = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    first = F.struct(start.cast(state_type).alias("s"), nothing.alias("o")).cast(acc_type)

    # no casts inside the loop: a cast of the accumulator would copy the collected outs at every step
    def one(acc: Column, day: Column) -> Column:
        state, out = step(acc["s"], day)
        return F.struct(state.alias("s"), F.concat(acc["o"], F.array(out)).alias("o"))

    def block(acc: Column, b: Column) -> Column:
        return F.aggregate(
            F.slice(days, b * BLOCK + 1, BLOCK),
            F.struct(acc["s"].alias("s"), nothing.alias("o")), one,
            lambda a: F.struct(a["s"].alias("s"), F.concat(acc["o"], a["o"]).alias("o")))

    return F.aggregate(blocks, first, block)["o"]
