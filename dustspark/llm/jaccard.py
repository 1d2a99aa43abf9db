"""Near-duplicates: SimHash links of the trie self-join, checked by exact Jaccard similarity (sets of five-word shingles, 0.8 or
more), and a prefix-filter join for the links that fingerprints lose.

First the texts' fingerprints are joined within the trie's budget (``simhash.py``). The texts of each component of fingerprints
make a chain in the order of their sizes, and its pairs are verified. Few bits differ between most near copies, but not between
all, so the rest of the links is found exactly, between different components only:

Shingles are put in one order for all documents: those that a sample finds frequent last, by frequency, then by hash. Two sets
that are similar enough share a shingle among the first n - ceil(0.8 n) + 1 of each, so only these are joined; sizes and
positions rule out more. The order, and with it the sample, decides the cost and never the result.

Many near copies share a shingle, and their pairs are not all built: first each shingle links its documents in a chain by size,
in one order for all shingles, so that chains of the same copies have the same pairs, and those between components are verified;
then each shingle pairs the documents of different components only.
A pair is verified by bits that bound its difference from below (parities of twice as many classes as a set has shingles, or
more), so that hardly any unlike texts are compared, then by its whole sets.
Links have exact similarity; a component is what they connect. Equal sets are one node, named by a 64-bit digest.

Words are lowercased in ASCII. A text of one to four words has its word sequence as the only shingle. Null, empty and
wordless texts have none, and are alike. Null ids are members, but name a component only if all its ids are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dustspark.llm.common import ship
from dustspark.llm.simhash import components, fingerprint, linked_pairs
from dustspark.session import cut_lineage, is_small

SHINGLE = 5
#: least similarity, a fraction
TIMES, OF = 4, 5
SEED = 42
#: documents of the sample, least of them with a frequent shingle, most frequent shingles that are told apart
SAMPLE, FREQUENT, MOST_FREQUENT = 4096, 3, 1 << 20
#: least words of 64 parities
PARITIES = 4


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text, sorted as signed numbers."""
    import xxhash

    ws = (text or "").encode().lower().split()  # bytes: A-Z only, the six ASCII spaces only
    if not ws:
        return np.zeros(0, np.int64)
    joined, hashed = b" ".join(ws), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    last = ends[min(SHINGLE, len(ws)) - 1:]
    starts = (ends - lengths)[:len(last)]
    return np.unique(np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), np.uint64, len(last)).view(np.int64))


def digest(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def parities(s: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each class: sets that differ in d shingles differ in at most d bits. The classes are a power of
    two, so that half of them are the exclusive or of the halves."""
    words = max(PARITIES, 1 << (len(s) // 32).bit_length())
    odd = np.bincount((s & (64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differ(x: str, y: str) -> Column:
    """Differing parities of two columns, in the classes of the shorter."""
    short = F.least(F.size(x), F.size(y))

    def word(bits: str, j: Column) -> Column:
        return F.aggregate(F.sequence(j, F.size(bits) - 1, short), F.lit(0).cast("long"), lambda all_, i: all_.bitwiseXOR(F.get(bits, i)))
    return F.aggregate(F.sequence(F.lit(0), short - 1), F.lit(0), lambda n, j: n + F.bit_count(word(x, j).bitwiseXOR(word(y, j))))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample (sorted), and in how many of its documents each is."""
    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"s": shingles(text)})

    share = SAMPLE / max(1, docs.count())
    rows = (docs if share >= 1 else docs.sample(share, SEED)).mapInPandas(sampled, "s bigint")
    found = rows.groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count")).limit(MOST_FREQUENT).toPandas()
    found = found.sort_values("s")
    return found["s"].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def _prints(frequent) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, count = frequent.value
        for batch in batches:
            rows = []
            for text in batch["text"]:
                s = shingles(text)
                n = len(s)
                often = np.zeros(n, np.int64)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, count[at], 0)
                first = s[np.lexsort((s, often))][:n - (n * TIMES + OF - 1) // OF + 1]
                rows.append((digest(s), int(np.uint64(fingerprint(text)).view(np.int64)), n, parities(s), first))
            out = pd.DataFrame(rows, columns=["node", "fp", "n", "bits", "first"])
            yield out.assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), key=batch["key"].to_numpy())[["doc_id", "key", "node", "fp", "n", "bits", "first"]]
    return prints


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        sets = {t: shingles(t) for t in {*batch["text_a"], *batch["text_b"]}}  # a text may be in many pairs
        for x, y in zip(batch["text_a"], batch["text_b"], strict=True):
            x, y = sets[x], sets[y]
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append((OF + TIMES) * both >= TIMES * (len(x) + len(y)))
        yield batch.loc[np.array(keep, bool), ["a", "b"]]


def _of(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias("node" if c == "node" else f"{c}_{side}") for c in nodes.columns]).withColumnRenamed("node", side)


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose whole sets are similar enough."""
    known = nodes.select("node", "key", "n", "bits")
    both = pairs.join(_of(known, "a"), "a").join(_of(known, "b"), "b")
    total = F.col("n_a") + F.col("n_b")
    both = both.where(OF * F.least("n_a", "n_b") >= TIMES * F.greatest("n_a", "n_b")).where((OF + TIMES) * _differ("bits_a", "bits_b") <= (OF - TIMES) * total)
    both = cut_lineage(both.select("a", "b", "key_a", "key_b"))
    keys = both.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    asked = F.broadcast(keys) if is_small(keys) else keys
    # texts travel, not sets: they take less room
    whole = texts.join(asked, "key", "left_semi").dropDuplicates(["key"])
    for side in ("a", "b"):
        both = both.join(whole.select(F.col("key").alias(f"key_{side}"), F.col("text").alias(f"text_{side}")), f"key_{side}")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_verified, "a bigint, b bigint")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labels(found: DataFrame) -> DataFrame:
    """(node, root) with the roots themselves."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _rooted(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))


def fingerprint_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of similar nodes among those whose fingerprints the trie self-join connects."""
    prints = cut_lineage(nodes.select("fp").distinct())
    group = _labels(components(linked_pairs(prints))).withColumnRenamed("node", "fp")
    rows = nodes.select("node", "fp", "n").join(group, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    after = rows.withColumn("next", F.lead("node").over(Window.partitionBy("root").orderBy("n", "node")))
    return cut_lineage(_similar(after.where("next IS NOT NULL").select(*_ordered("node", "next")), nodes, texts))


def links(nodes: DataFrame, first: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of similar nodes; not every pair, but every connection. ``first``: (node, n, first), the first shingles of
    each set; ``texts``: (key, text), with every key of the nodes."""
    near = fingerprint_links(nodes, texts)
    label = _labels(components(near))
    rows = first.select("node", "n", F.posexplode("first").alias("pos", "s"))
    w = Window.partitionBy("s").orderBy("n", "node")
    rows = rows.withColumns({"next": F.lead("node").over(w), "before": F.lag("node").over(w)})
    shared = cut_lineage(rows.where("next IS NOT NULL OR before IS NOT NULL").drop("before"))
    chains = shared.where("next IS NOT NULL").select(*_ordered("node", "next")).distinct()
    for side in ("a", "b"):
        chains = _rooted(chains.withColumnRenamed(side, "node"), label).withColumnsRenamed({"node": side, "root": f"root_{side}"})
    chains = cut_lineage(chains.where("root_a <> root_b").select("a", "b"))
    chained = near.unionByName(cut_lineage(_similar(chains, nodes, texts)))
    rows = _rooted(shared.drop("next"), _labels(components(chained)))
    held = rows.groupBy("s", "root").count().groupBy("s").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("count", "root")).alias("most"))
    open_ = cut_lineage(rows.join(held.where("roots > 1").select("s", F.col("most.root").alias("most")), "s"))
    x = open_.where("root <> most").select("s", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"), F.col("root").alias("root_x"))
    both = x.join(open_, "s").where("root <> root_x AND (root = most OR x < node)")
    both = both.where(OF * F.least("n_x", "n") >= TIMES * F.greatest("n_x", "n"))
    # of the first shingle that both have, no more than the rest of either can follow
    both = both.where((OF + TIMES) * F.least(F.col("n_x") - F.col("pos_x"), F.col("n") - F.col("pos")) >= TIMES * (F.col("n_x") + F.col("n")))
    left = both.select(*_ordered("x", "node")).distinct().join(chains, ["a", "b"], "left_anti")  # pairs of the chains have been verified
    return chained.unionByName(cut_lineage(_similar(left, nodes, texts)))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the smallest id reachable."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts.select("text")))
    prints = cut_lineage(texts.mapInPandas(_prints(frequent), "doc_id bigint, key bigint, node bigint, fp bigint, n int, bits array<bigint>, first array<bigint>"))
    # of equal sets one text stands for all, with its own fingerprint
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("key", "fp")).alias("text"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    nodes = cut_lineage(nodes.select("node", "least_id", "text.*", "n", "bits"))
    # first shingles are read once, so they are not written again
    first = prints.groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"))
    found = components(links(nodes, first, texts.select("key", "text")))
    member = _labels(found).join(nodes.select("node", "least_id"), "node")
    named = member.join(member.groupBy("root").agg(F.min("least_id").alias("named")), "root").select("node", "named")
    label = nodes.select("node", "least_id").join(named, "node", "left").select("node", F.coalesce("named", "least_id").alias("component_id"))
    return prints.select("doc_id", "node").join(label, "node").select("doc_id", "component_id")
