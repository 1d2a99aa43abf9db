"""Phrase collocations per language: phrases of two or three words by a squared-count score, grown best-first under bounds.

A phrase with count a, cut into parts with counts l and r, scores floor(1000000 a a / (l r)); its worst cut counts. Phrases grow
from counted prefixes. A word less frequent than ``LEAST`` begins no candidate, and a pair (x, y) bounds every phrase it begins:
a is at most f(x y) and at most the count of the rest, so no (x, y, z) scores above floor(1000000 f(x y) / f(x)).
The frontier is expanded in falling order of bounds, a threshold per language at a time: one pass counts the triples whose first pair
has a bound, or whose last pair has a score, at the threshold or above. Then every triple that scores as much is known, and
every pair that scores as much is either dropped by a known triple or survives. A language is settled once ``TOP`` survivors,
ties included, are at its threshold; the others' thresholds fall, to 0 at last, where nothing is left unexpanded.

Words are counted under 64-bit hashes of language and word; a collision among all words makes the job start anew with the
next seed, so counts are exact. Each task counts a few megabytes of text at once in numpy, Spark adds up after partial sums. The
filters that keep infrequent words and pairs out of the shuffle have ``BITS`` bits and let some through, which the exact
counts and joins remove; once the vocabulary is much larger, they let all through. Products have up to 38 digits: counts up to 10^16 are exact.

ASCII letters are lowercased; a null text is empty and has no word, a null language is ``und``. Equal rows count each. Empty table: no phrase.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustspark.llm.common import ship
from dustspark.session import scratch

LEAST, SHARE, TOP, SCALE = 10, 50, 2000, 1_000_000
#: bytes of text that are counted at once, bits of a filter (8 MB), scores of a step of the thresholds
TURN_BYTES, BITS, STEP = 1 << 23, 1 << 26, 100
_BREAK, _GAP = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(_GAP)] = 1
_KIND[list(_BREAK)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


# ---- words of a turn, as numbers
class Turn:
    """The words of some texts: ``word`` numbers the distinct (language, word) pairs, ``piece`` the stretches without a break."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int) -> None:
        import xxhash

        texts = texts.cast(pa.large_binary()).fill_null(b"")
        edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]]
        edges = edges - edges[0]
        kind = _KIND[raw]
        inside = kind == 0
        begin = inside & np.concatenate([[True], ~inside[:-1]]) if len(raw) else inside
        heads = edges[:-1][edges[:-1] < len(raw)]
        begin[heads] = inside[heads]
        starts = np.flatnonzero(begin)
        doc = np.searchsorted(edges, starts, "right")
        self.piece = np.cumsum(kind == 2)[starts] + doc if len(starts) else doc
        data = _LOWER[raw[inside]].tobytes()
        ends = np.append((np.cumsum(inside) - 1)[starts], len(data)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        lang = langs.fill_null("und").dictionary_encode()
        n = max(1, len(lang.dictionary))
        both = found.indices.to_numpy().astype(np.int64) * n + lang.indices.to_numpy()[doc - 1] if len(starts) else np.zeros(0, np.int64)
        pairs, self.word, self.count = np.unique(both, return_inverse=True, return_counts=True)
        self.texts, self.langs = found.dictionary.take(pa.array(pairs // n)), lang.dictionary.take(pa.array(pairs % n))
        names = [x.encode() + b"\0" for x in lang.dictionary.to_pylist()]
        words = found.dictionary.to_pylist()
        self.hash = np.fromiter((xxhash.xxh64_intdigest(names[p % n] + words[p // n], seed) for p in pairs.tolist()), np.uint64, len(pairs)).view(np.int64)

    def adjacent(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each place on lie in one piece."""
        return self.piece[n - 1:] == self.piece[:max(0, len(self.piece) - n + 1)]


def _turns(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[Turn]:
    for batch in batches:
        sizes = np.diff(np.frombuffer(batch.column(0).cast(pa.large_binary()).fill_null(b"").buffers()[1], np.int64, len(batch) + 1)) if len(batch) else []
        turn = np.cumsum(sizes) // TURN_BYTES
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield Turn(batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), seed)


def _slots(*hashes: np.ndarray) -> np.ndarray:
    """The bit of a word or of a pair of words in a filter."""
    mixed = hashes[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for h in hashes[1:]:
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ h.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


# ---- counting passes
def _counted(docs: DataFrame, schema: str, rows: Callable[[Turn], list], seed: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn in _turns(batches, seed):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in rows(turn)], names)
    return docs.mapInArrow(run, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("a"))


def _words(docs: DataFrame, seed: int) -> DataFrame:
    return _counted(docs, "lang string, word string, h bigint, n bigint", lambda t: [t.langs, t.texts.cast(pa.large_string()).cast(pa.string()), t.hash, t.count], seed)


def _pairs(docs: DataFrame, seed: int, frequent) -> DataFrame:
    def rows(t: Turn) -> list:
        known = _has(frequent.value, _slots(t.hash))[t.word]
        x, y = t.word[:-1], t.word[1:]
        some = t.adjacent(2) & known[:-1] & known[1:]
        m = max(1, len(t.hash))
        pair, n = np.unique(x[some] * m + y[some], return_counts=True)
        return [t.hash[pair // m], t.hash[pair % m], n]
    return _counted(docs, "h1 bigint, h2 bigint, n bigint", rows, seed)


def _triples(docs: DataFrame, seed: int, frequent, first, last) -> DataFrame:
    """Triples of two frequent pairs of which the first is in ``first`` or the last in ``last``."""
    def rows(t: Turn) -> list:
        slot = _slots(t.hash[t.word[:-1]], t.hash[t.word[1:]])
        known = t.adjacent(2) & _has(frequent.value, slot)
        at = np.flatnonzero(known[:-1] & known[1:])
        at = at[_has(first.value, slot[at]) | _has(last.value, slot[at + 1])]
        m = max(1, len(t.hash))
        pair, which = np.unique(t.word[at] * m + t.word[at + 1], return_inverse=True)
        triple, n = np.unique(which * m + t.word[at + 2], return_counts=True)
        return [t.hash[pair[triple // m] // m], t.hash[pair[triple // m] % m], t.hash[triple % m], n]
    return _counted(docs, "h1 bigint, h2 bigint, h3 bigint, n bigint", rows, seed)


def _filter(rows: DataFrame, *hashes: str):
    """A broadcast array of ``BITS`` bits with those of the rows set."""
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slots(*[c.to_numpy(zero_copy_only=False) for c in b.columns])) + 1)], ["slot"])
    bits = np.zeros(BITS // 8, np.uint8)
    parts = rows.select(*hashes).mapInArrow(slots, "slot bigint").groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in parts.toLocalIterator():  # at most BITS / 32768 rows of 4 KB
        at = (r["part"] - 1) * 4096
        bits[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits)


# ---- scores
def _score(a: str, left: str, right: str) -> Column:
    a, left, right = (f"CAST({x} AS DECIMAL(16, 0))" for x in (a, left, right))
    return F.expr(f"CAST({a} * {a} AS DECIMAL(32, 0)) * {SCALE} DIV CAST({left} * {right} AS DECIMAL(32, 0))")


def _written(spark: SparkSession, rows: DataFrame, name: str, folder: str) -> DataFrame:
    rows.write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


def _thresholds(pairs: DataFrame, below: DataFrame | None, rank: int) -> DataFrame:
    """(lang, least): per language the highest step of scores that ``rank`` pairs reach, under the threshold before; else 0."""
    steps = pairs.groupBy("lang", F.floor(F.col("score") / STEP).alias("step")).count()
    w = Window.partitionBy("lang").orderBy(F.desc("step"))  # at most SCALE / STEP + 1 rows a language
    steps = steps.withColumn("reached", F.sum("count").over(w))
    langs = pairs.select("lang").distinct() if below is None else below.select("lang", F.col("least").alias("before"))
    steps = steps.join(langs, "lang").where(F.col("reached") >= rank)
    if below is not None:
        steps = steps.where(F.col("step") * STEP < F.col("before"))
    best = steps.groupBy("lang").agg(F.max("step").alias("step"))
    return langs.select("lang").join(best, "lang", "left").select("lang", F.coalesce(F.col("step") * STEP, F.lit(0)).cast("long").alias("least"))


def mine(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score, count and text.

    Candidates have ``least`` occurrences. One whose words lie in a longer candidate with ``share`` percent of its count is dropped.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    folder = scratch(spark)
    for seed in itertools.count(1):
        words = _written(spark, _words(docs, seed), f"words-{seed}", folder)
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
    total = words.groupBy("lang").agg(F.sum("a").alias("n"))
    words = _written(spark, words.where(F.col("a") >= least), "frequent-words", folder)
    counted = _pairs(docs, seed, _filter(words, "h")).where(F.col("a") >= least)
    counted = counted.join(words.select(F.col("h").alias("h1"), F.col("a").alias("l"), "lang"), "h1").join(words.select(F.col("h").alias("h2"), F.col("a").alias("r")), "h2")
    counted = counted.select("lang", "h1", "h2", "a", "l", "r", _score("a", "l", "r").alias("score"), F.expr(f"CAST(a AS DECIMAL(16, 0)) * {SCALE} DIV CAST(l AS DECIMAL(16, 0))").alias("bound"))
    pairs = _written(spark, counted, "pairs", folder)
    frequent = _filter(pairs, "h1", "h2")
    before = pairs.select("h1", "h2", F.col("a").alias("a12"), F.col("l").alias("f1"))
    after = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("a23"), F.col("r").alias("f3"), "lang")

    known: DataFrame | None = None
    asked, settled = _written(spark, _thresholds(pairs, None, 2 * top), "thresholds-0", folder), None
    for turn in itertools.count():
        at = pairs.join(F.broadcast(asked) if turn else asked, "lang")  # one row a language that is not settled
        met = _triples(docs, seed, frequent, _filter(at.where("bound >= least"), "h1", "h2"), _filter(at.where("score >= least"), "h1", "h2"))
        rows = met.where(F.col("a") >= least).join(before, ["h1", "h2"]).join(after, ["h2", "h3"])
        first, last = _score("a", "f1", "a23"), _score("a", "a12", "f3")
        rows = rows.withColumns({"first": first, "last": last}).withColumn("score", F.least("first", "last"))
        rows = rows.select("lang", "h1", "h2", "h3", "a", F.when(F.expr("first <= last"), F.col("f1")).otherwise(F.col("a12")).alias("l"),
                           F.when(F.expr("first <= last"), F.col("a23")).otherwise(F.col("f3")).alias("r"), "score", "a12", "a23")
        if known is not None:
            rows = known.unionByName(rows).dropDuplicates(["h1", "h2", "h3"])  # a triple has the same counts in every pass
        known = _written(spark, rows, f"triples-{turn}", folder)
        inside = known.where(F.col("a") * 100 >= F.col("a12") * share).select("h1", "h2").unionByName(
            known.where(F.col("a") * 100 >= F.col("a23") * share).select(F.col("h2").alias("h1"), F.col("h3").alias("h2"))).distinct()
        alone = pairs.join(inside, ["h1", "h2"], "left_anti").withColumn("h3", F.lit(None).cast("long"))
        columns = ["lang", "h1", "h2", "h3", "a", "l", "r", "score"]
        phrases = alone.select(*columns).unionByName(known.select(*columns))
        now = asked.withColumn("open", F.lit(True))
        if settled is not None:
            now = settled.withColumn("open", F.lit(False)).unionByName(now)
        reached = phrases.join(F.broadcast(now), "lang").where("score >= least")
        held = reached.groupBy("lang").agg(F.count(F.lit(1)).alias("held"))
        state = _written(spark, now.join(held, "lang", "left").withColumn("open", F.expr(f"open AND least > 0 AND coalesce(held, 0) < {top}")), f"state-{turn}", folder)
        settled, asked = (state.where(c).select("lang", "least") for c in ("NOT open", "open"))
        if asked.isEmpty():
            break
        asked = _written(spark, _thresholds(pairs, asked, 2 * top * 4 ** (turn + 1)), f"thresholds-{turn + 1}", folder)

    by_rank = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = reached.withColumn("rank", F.rank().over(by_rank)).where(F.col("rank") <= top).drop("rank")  # with all ties of the last
    for k in (1, 2, 3):
        best = best.join(words.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}")), f"h{k}", "left")
    best = best.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """The same rows in DuckDB."""
    def score(left: str, right: str) -> str:
        return f"{SCALE}::HUGEINT * a * a // ({left}::HUGEINT * {right})"

    return f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS x FROM d)),
u AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM p) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY lang),
b AS (SELECT lang, x, y, count(*) AS a FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM p)) GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT lang, x, y, z, count(*) AS a FROM (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM p)) GROUP BY ALL HAVING count(*) >= {least}),
two AS (SELECT b.*, u.f AS l, v.f AS r FROM b JOIN u ON u.lang = b.lang AND u.w = x JOIN u AS v ON v.lang = b.lang AND v.w = y),
three AS (SELECT c.*, p.l AS f1, s.a AS f23, p.a AS f12, s.r AS f3 FROM c JOIN two AS p ON p.lang = c.lang AND p.x = c.x AND p.y = c.y JOIN two AS s ON s.lang = c.lang AND s.x = c.y AND s.y = c.z),
cuts AS (SELECT *, {score('f1', 'f23')} AS s1, {score('f12', 'f3')} AS s2 FROM three),
gone AS (SELECT lang, x, y FROM three WHERE 100 * a >= {share} * f12 UNION SELECT lang, y, z FROM three WHERE 100 * a >= {share} * f23),
phrases AS (SELECT lang, x || ' ' || y AS phrase, a, l, r, {score('l', 'r')} AS score FROM two ANTI JOIN gone USING (lang, x, y)
    UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, if(s1 <= s2, f1, f12), if(s1 <= s2, f23, f3), least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM phrases)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN t USING (lang) WHERE rank <= {top}"""
