"""Quality rules: a threshold table compiled into one projection.

Everything is a built-in expression over one row, so the plan is a scan and a projection without an exchange.
Null text counts as empty. Rows are judged alone: repeated rows get the same verdict, an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import WORD, let, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

# Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is a that it for on are as with was be this by from or an at not but have he she they we you his her "
    "le la les de des un une et est en que qui dans pour pas sur au par avec ce il ne se du plus sont "
    "der die das und ist ein eine zu den von mit sich auf für nicht im dem auch es als an werden aus "
    "el los las y que por con para su una al lo como más pero sus se o este ha"
).split()

# name, metric, least, most (None: open). A metric that is null (its denominator is zero) passes.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("short", "n_words", 20, None),
    ("word_length", "mean_word_length", 2.0, 12.0),
    ("symbols", "symbols_per_word", None, 0.10),
    ("shouting", "exclamations_per_word", None, 0.30),
    ("stop_words", "stop_word_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.50),
    ("bullets", "bullet_line_ratio", None, 0.90),
    ("ellipses", "ellipsis_line_ratio", None, 0.30),
)


def _repeat_words(ws: Column, n: Column) -> Column:
    """Positions inside windows of eight words that occur again in the text, by 64-bit window hashes.

    The hash of eight words comes from two hashes of four, and so on, so that each level costs one pass. Only texts with
    a repeated window sort their windows.
    """
    def pairs(h: Column, gap: int, taken: int) -> Column:
        k = n - taken
        return F.zip_with(F.slice(h, 1, k), F.slice(h, 1 + gap, k), lambda a, b: F.xxhash64(a, b))

    def covered(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        repeated = let(order, lambda s: F.transform(s, lambda e, i: F.when(
            (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]), e["i"])))
        starts = F.sort_array(F.filter(repeated, lambda i: i.isNotNull()))
        return let(starts, lambda p: F.aggregate(
            F.transform(p, lambda v, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - v, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b))

    by8 = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h1: let(pairs(h1, 1, 1), lambda h2: let(
        pairs(h2, 2, 3), lambda h4: pairs(h4, 4, WINDOW - 1))))
    count = let(by8, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the row itself as struct ``doc`` and its metrics."""
    t = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), t.alias("t")).select(
        "doc", "t", words(F.col("t")).alias("ws"), F.split("t", "\n").alias("ls"))
    n = F.size("ws")
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    counted = split.select(
        "doc", n.cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(F.filter("ls", lambda x: x.rlike(WORD)), lambda x: F.struct(
            F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            F.size(F.filter(x, lambda v: v.rlike(r"^\s*[-*•]"))).alias("bullets"),
            F.size(F.filter(x, lambda v: v.rlike(r"(\.\.\.|…)\s*$"))).alias("ellipses"))).alias("l"),
        _repeat_words(F.col("ws"), n).cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("exclamations"),
        F.size(F.filter("ws", lambda w: F.array_contains(stop, F.lower(w)))).cast("long").alias("stops"))

    def per(a: str | Column, b: str | Column) -> Column:
        a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
        return F.when(b > 0, a.cast("double") / b)
    return counted.select(
        "doc", "n_words", "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word_length"), per("n_symbols", "n_words").alias("symbols_per_word"),
        per("exclamations", "n_words").alias("exclamations_per_word"), per("stops", "n_words").alias("stop_word_ratio"),
        per(F.col("l.dup"), F.col("l.lines")).alias("dup_line_ratio"),
        per(F.col("l.bullets"), F.col("l.lines")).alias("bullet_line_ratio"),
        per(F.col("l.ellipses"), F.col("l.lines")).alias("ellipsis_line_ratio"))


def judge(measured: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (names, comma-joined, in table order) and ``kept``."""
    failed = []
    for name, metric, least, most in rules:
        v = F.col(metric)
        bad = [v < least] if least is not None else []
        bad += [v > most] if most is not None else []
        broken = bad[0] if len(bad) == 1 else bad[0] | bad[1]
        failed.append(F.when(F.coalesce(broken, F.lit(False)), F.lit(name)))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = measured.withColumn("base_failed", base).withColumn("failed_rules", F.concat_ws(",", *failed))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_good(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged.

    A filter would be pushed below the projection with each metric written out wherever a rule reads it; an array of the
    row or of nothing leaves the metrics where they are computed once.
    """
    return judge(measure(docs), rules).select(F.explode(F.when(F.col("kept"), F.array("doc"))).alias("doc")).select("doc.*")
