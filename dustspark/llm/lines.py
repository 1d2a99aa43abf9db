"""Line dedup by winnowing over line hashes.

A gram is the shortest stretch of lines from a given line on with at least GRAM_WORDS words. Of each stretch of gram
starts that spans GRAM_WORDS words, the gram with the smallest hash is a fingerprint (of equal ones the last), so every
repeated run of at least twice GRAM_WORDS words shares one. Each later fingerprint meets the first place of that
fingerprint (in the order of ids, then lines); on that offset the two documents are compared line by line, both ways,
and every maximal equal run of at least GRAM_WORDS words is deleted from the later document. The first place of a line is
never deleted, as each deleted line has an equal one before it.

Only hashes are shuffled: a fingerprint meets one first place, not all others, so a passage of a third of all documents
gives one row per document. Texts are shuffled once, to the runs to be deleted.

Null text stays null, empty text stays empty. Lines without a word belong to runs like others and count no words. Null
ids come last. Rows that repeat an id with its text are one document, and keep or lose the same lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import let, words
from dustspark.session import cut_lineage

GRAM_WORDS = 20
LAST_ID = (1 << 63) - 1


def _ends(cum: Column, n: Column) -> Column:
    """For each line i the last line j (0-based) with at least GRAM_WORDS words in i..j; null if the text ends before.

    ``cum`` has the words before each line and, last, all words; the search is binary.
    """
    def reach(i: Column) -> Column:
        goal = F.get(cum, i) + GRAM_WORDS
        low = F.aggregate(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), F.lit(0), lambda at, step: F.when(
            (at + step <= n) & (F.get(cum, at + step) < goal), at + step).otherwise(at))
        return F.when(low < n, low)
    return F.transform(F.sequence(F.lit(0), n - 1), reach)


def line_table(docs: DataFrame) -> DataFrame:
    """(id, text_hash, hashes, cum) of every distinct document with a word, cut from its texts."""
    key = [F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).cast("long").alias("id"), F.xxhash64("text").alias("text_hash")]
    split = docs.where(F.col("text").isNotNull()).select(*key, F.split("text", "\n").alias("ls"))
    counts = split.select("id", "text_hash", F.transform("ls", lambda x: F.xxhash64(x)).alias("hashes"),
                          F.transform("ls", lambda x: F.size(words(x))).alias("counts"))
    # words before each line, as running sums over blocks: appends stay short
    cum = F.aggregate("counts", F.struct(F.lit(0).alias("sum"), F.array(F.lit(0)).alias("block"), F.array().cast("array<array<int>>").alias("done")), lambda s, c: F.when(
        F.size(s["block"]) < 64, F.struct((s["sum"] + c).alias("sum"), F.concat(s["block"], F.array(s["sum"] + c)).alias("block"), s["done"].alias("done"))).otherwise(
        F.struct((s["sum"] + c).alias("sum"), F.array(s["sum"] + c).alias("block"), F.concat(s["done"], F.array(s["block"])).alias("done"))),
        lambda s: F.flatten(F.concat(s["done"], F.array(s["block"]))))
    return counts.select("id", "text_hash", "hashes", cum.alias("cum")).where(F.element_at("cum", -1) > 0).dropDuplicates(["id", "text_hash"])


def fingerprints(lines: DataFrame) -> DataFrame:
    """(gram, id, text_hash, line): the winnowed grams of every document."""
    n = F.size("hashes")
    grams = lines.select("id", "text_hash", "hashes", "cum", _ends(F.col("cum"), n).alias("ends")).select(
        "id", "text_hash", "cum", "ends", let(F.col("hashes"), lambda h: F.transform("ends", lambda e, i: F.when(
            e.isNotNull(), F.xxhash64(F.slice(h, i + 1, e - i + 1))))).alias("grams"))
    # of each stretch i..ends[i] of starts the smallest gram; stretches that reach behind the last gram end there
    last = F.array_max(F.transform("grams", lambda g, i: F.when(g.isNotNull(), i)))
    chosen = let(F.col("grams"), lambda g: F.transform(F.filter("ends", lambda e: e.isNotNull()), lambda e, i: -F.array_min(F.transform(
        F.sequence(i, F.least(e, last)), lambda j: F.struct(F.get(g, j).alias("g"), (-j).alias("j"))))["j"]))
    return grams.where(last.isNotNull()).select("id", "text_hash", "grams", F.explode(F.array_distinct(chosen)).alias("line")).select(
        F.get("grams", F.col("line")).alias("gram"), "id", "text_hash", "line")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(id, text_hash, runs): per document the line ranges (low, high) to be deleted."""
    lines = cut_lineage(line_table(docs))
    prints = fingerprints(lines)
    place = F.struct("id", "text_hash", "line")
    first = prints.groupBy("gram").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = prints.join(first, "gram").where(place != F.col("first"))
    pairs = met.select("id", "text_hash", F.col("first.id").alias("to_id"), F.col("first.text_hash").alias("to_hash"),
                       (F.col("line") - F.col("first.line")).alias("gap")).distinct()
    theirs = lines.select(F.col("id").alias("to_id"), F.col("text_hash").alias("to_hash"), F.col("hashes").alias("theirs"))
    both = pairs.join(theirs, ["to_id", "to_hash"]).join(lines, ["id", "text_hash"])
    low, high = F.greatest(F.lit(0), F.col("gap")), F.least(F.size("hashes"), F.size("theirs") + F.col("gap"))
    equal = F.zip_with(F.slice("hashes", low + 1, high - low), F.slice("theirs", low - F.col("gap") + 1, high - low), lambda a, b: a == b)
    # runs lie between neighbouring places that differ
    breaks = both.select("id", "text_hash", "cum", F.concat(F.array(low - 1), F.filter(F.transform(equal, lambda e, i: F.when(
        ~e, low + i)), lambda i: i.isNotNull()), F.array(high)).alias("at"))
    runs = let(F.col("at"), lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, i: F.struct(
        (a + 1).alias("low"), (F.get(at, i + 1) - 1).alias("high"))))
    long = F.filter(runs, lambda r: (r["high"] >= r["low"]) & (F.get("cum", r["high"] + 1) - F.get("cum", r["low"]) >= GRAM_WORDS))
    return breaks.select("id", "text_hash", F.explode(long).alias("run")).groupBy("id", "text_hash").agg(
        F.sort_array(F.collect_set("run")).alias("runs"))


def mark(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the row as struct ``doc``, ``n_lines``, ``deleted`` (line numbers from 0) and the ``text`` left."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = rows.select("doc", F.coalesce(F.col("doc.doc_id"), F.lit(LAST_ID)).cast("long").alias("id"), F.xxhash64("doc.text").alias("text_hash"))
    rows = rows.join(repeated_runs(docs), ["id", "text_hash"], "left")
    gone = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["low"], r["high"]))))
    rows = rows.select("doc", F.sort_array(F.coalesce(gone, F.array().cast("array<int>"))).alias("deleted"))
    lines = F.split("doc.text", "\n")
    # the deleted numbers become nulls at their places, which costs one pass each
    marks = F.when(F.size("deleted") > 0, let(F.map_from_arrays("deleted", F.transform("deleted", lambda x: F.lit(True))), lambda m: F.array_join(
        F.filter(lines, lambda x, i: F.get(F.array(m[i]), F.lit(0)).isNull()), "\n"))).otherwise(F.col("doc.text"))
    return rows.select("doc", F.when(F.col("doc.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), "deleted", marks.alias("text"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated runs deleted from the texts; all rows stay, ``n_chars`` follows the text."""
    done = mark(docs)
    fields = []
    for c in docs.columns:
        if c == "text":
            fields.append(F.col("text"))
        elif c == "n_chars":
            fields.append(F.when(F.size("deleted") == 0, F.col("doc.n_chars")).otherwise(F.length("text").cast("long")).alias(c))
        else:
            fields.append(F.col(f"doc.`{c}`").alias(c))
    return done.select(*fields)
