"""Document fingerprints from closed syncmers.

A k-mer of five words is chosen when the smallest of its inner 2-word hashes is the first or the last; whether it is chosen
depends on its own words only, so the same passage has the same anchors in any document, and ``placed`` gives each anchor
with its word position, for matching passages by position. Two documents are compared by all their anchors: the share of common
ones among those of either. The printed fingerprint is the SIZE smallest of them, as hex.

Texts of one to four words, and longer ones in which no k-mer is chosen, have their word sequence as the only anchor; a text
without words has none. Null text is empty. Two texts without anchors are alike (1.0), one without is unlike any other (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark.llm.common import let, partitions, words
from dustspark.llm.ranges import RANGES_PER_PARTITION, cuts, place

K = 5
SIZE = 64


def placed(text: Column) -> Column:
    """Every anchor of a text with the position of its first word: array of (position, hash), hashes below 2^32."""
    def at(i: Column, value: Column) -> Column:
        return F.struct(i.cast("int").alias("position"), F.shiftrightunsigned(value, 32).alias("hash"))

    def chosen(h: Column, n: Column) -> Column:
        pairs = F.zip_with(F.slice(h, 1, n - 1), F.slice(h, 2, n - 1), lambda a, b: F.xxhash64(a, b))

        def edge(p: Column) -> Column:
            def test(i: Column) -> Column:
                a, d = F.get(p, i), F.get(p, i + 3)
                return F.least(a, d) <= F.least(F.get(p, i + 1), F.get(p, i + 2))
            return F.transform(F.filter(F.sequence(F.lit(0), n - K), test), lambda i: at(i, F.xxhash64(F.get(p, i), F.get(p, i + 2), F.get(h, i + 4))))
        return let(pairs, edge)

    def hashed(ws: Column) -> Column:
        n = F.size(ws)
        whole = F.array(at(F.lit(0), F.xxhash64(ws)))
        some = F.when(n >= K, let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: chosen(h, n)))
        return F.when(n > 0, let(some, lambda found: F.when(F.size(found) > 0, found).otherwise(whole))).otherwise(F.slice(whole, 1, 0))
    return let(words(text), hashed)


def anchors(text: Column) -> Column:
    """The distinct anchor hashes of a text, sorted (array of long)."""
    return F.sort_array(F.array_distinct(F.transform(placed(text), lambda x: x["hash"])))


def printed(hashes: Column) -> Column:
    """The fingerprint: the SIZE smallest of the sorted hashes."""
    return F.array_join(F.transform(F.slice(hashes, 1, SIZE), lambda v: F.lower(F.lpad(F.hex(v), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all of both."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def with_next(rows: DataFrame, order: str, carried: list[str]) -> DataFrame:
    """Adds ``next_<c>`` of the next row by ``order`` (after the last: the first) for each carried column.

    Quantiles of the order cut it into ranges; each range is one window. The row at a cut goes to the range before as well, as
    its guard, so no range needs another. The row order among equal or null values is by the carried columns.
    """
    least, points = cuts(rows, order, partitions(rows.sparkSession) * RANGES_PER_PARTITION)
    key = F.col(order)
    at = place(key, points)
    last = len(points)
    start = F.when(key == F.lit(least), F.lit(True)).otherwise(F.lit(False)) if least is not None else F.lit(True)
    cut = F.array_contains(F.array(*[F.lit(c).cast("long") for c in points]), key) if points else F.lit(False)
    homes = F.concat(F.array(F.struct(at.alias("range"), F.lit(0).alias("guard"))),
                     F.when(F.coalesce(cut, F.lit(False)), F.array(F.struct((at - 1).alias("range"), F.lit(1).alias("guard")))).otherwise(F.array()),
                     F.when(F.coalesce(start, F.lit(False)), F.array(F.struct(F.lit(last).alias("range"), F.lit(2).alias("guard")))).otherwise(F.array()))
    dealt = rows.withColumn("home", F.explode(homes)).withColumns({"range": F.col("home.range"), "guard": F.col("home.guard")}).drop("home")
    # guard 1: first row of the next range; guard 2: first row of all, behind the last
    w = Window.partitionBy("range").orderBy("guard", F.col(order).asc_nulls_last(), *carried)
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return out.where("guard = 0").drop("range", "guard")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, the text whose last half is replaced from the next document, and both likenesses."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    # texts travel, not anchors: those of the next document are made again from its text
    rows = with_next(rows, "doc_id", ["t"])
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    following = F.coalesce("next_t", "t")
    edited = F.concat(F.substring("t", F.lit(1), n - half), F.substring(following, F.lit(1), half))
    # arrays of one row or none keep an expression that is used twice from being computed twice
    made = F.array(F.struct("doc_id", n.cast("long").alias("n_chars"), anchors(F.col("t")).alias("a"), anchors(following).alias("b"), F.sha2(edited, 256).alias("edited_sha256"), anchors(edited).alias("e")))
    rows = rows.select(F.inline(made))
    return rows.select("doc_id", "n_chars", "edited_sha256", printed(F.col("a")).alias("fingerprint"), printed(F.col("e")).alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("b")).alias("near_next"))
