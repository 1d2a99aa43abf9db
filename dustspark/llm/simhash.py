"""SimHash near-duplicates: 64-bit fingerprints of 4-word shingles, linked at up to BUDGET differing bits, by a trie self-join.

The binary trie over the fingerprints is traversed as node pairs: both nodes split on the next bit, a differing bit costs one
of the budget, and a pair that has spent more is pruned. Pairs of small nodes are compared directly.

To spread the traversal over tasks the 64 bits are cut into BUDGET + 1 blocks. Two fingerprints within the budget agree on at
least one block, so the trie is built once per block with that block's bits on top, and each value of the block is a subtree
whose self-pair is one unit of work (about 2^-13 of the fingerprints). A subtree larger than the mean load of a partition (many
near copies) is dealt into chunks by hash, and its chunk pairs are separate units: no unit grows with the largest group.

A unit returns the links as a spanning forest of the fingerprints it holds; connected components are then found over the links
by large-star and small-star steps, each step checkpointed. Equal texts have one fingerprint and are one node from the start.

Null or empty text: fingerprint zero, linked like any other. Null ids are members, but name a component only if all its ids are
null. Repeated rows are members like others. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import partitions, ship
from dustspark.session import cut_lineage

SHINGLE = 4
SEED = 42
BUDGET = 4
#: first bit and width of each block
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
LEAST_CHUNK, MOST_CHUNK = 2048, 1 << 18
#: rows of units that are traversed together, and node pairs that are expanded together
BATCH_ROWS, BATCH_PAIRS = 1 << 17, 1 << 20
#: node pairs with at most so many element pairs are compared directly
DIRECT = 12
#: links of one task in a round of the stars
ROUND_LINKS = 1 << 14


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes, repeats included."""
    import xxhash

    ws = (text or "").encode().lower().split()  # bytes: A-Z only, the six ASCII spaces only
    if not ws:
        return 0
    if len(ws) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(ws), SEED)
    joined, n, hashed = b" ".join(ws), len(ws) - SHINGLE + 1, xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, ws), np.int64, len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        counts += np.unpackbits(h[i:i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in batch["text"]), np.uint64, len(batch)).view(np.int64)
        yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": prints})


# ---- the traversal inside a task
def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_links(bits: np.ndarray, side: np.ndarray, unit: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked elements. Rows are sorted by (unit, side, bits); side 0 and 0 of a unit pair if it has no side 1,
    else side 0 with side 1. ``top``: bits of each row that are equal throughout its unit."""
    n = len(bits)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[new[1:], n]
    first = side[new] == 0
    paired = np.r_[(unit[new][1:] == unit[new][:-1]), False] & first
    a = np.flatnonzero(first)
    b = np.where(paired[a], a + 1, a)
    same = a == b
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    # neighbours in the order of the trie; stretches of linked neighbours need no pairs among themselves
    near = np.r_[False, (_popcount(bits[1:] ^ bits[:-1]) <= BUDGET) & (unit[1:] == unit[:-1]) & (side[1:] == side[:-1])]
    linked = np.flatnonzero(near)
    found_a.append(linked - 1)
    found_b.append(linked)
    stretch = np.cumsum(~near)
    ones: dict[int, np.ndarray] = {}

    def ones_before(depth: int) -> np.ndarray:
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((bits >> np.uint64(63 - depth)) & np.uint64(1))].astype(np.int64)
        return ones[depth]

    stack = [(int(t), np.array([new[a[k]], end[a[k]], new[b[k]], end[b[k]], np.zeros(len(k), np.int64), same[k]], dtype=np.int64))
             for t in np.unique(top) for k in [np.flatnonzero(top[new[a]] == t)]]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > BATCH_PAIRS:
            for i in range(0, pairs.shape[1], BATCH_PAIRS):
                stack.append((depth, pairs[:, i:i + BATCH_PAIRS]))
            continue
        alo, ahi, blo, bhi, spent, own = pairs
        live = (ahi > alo) & (bhi > blo) & (spent <= BUDGET) & ~((own == 1) & (ahi - alo < 2))
        pairs = pairs[:, live]
        linked_all = (pairs[5] == 1) & (stretch[pairs[0]] == stretch[pairs[1] - 1])
        pairs = pairs[:, ~linked_all]
        if not pairs.shape[1]:
            continue
        size = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
        small = (size <= DIRECT) if depth < 64 else np.ones(len(size), bool)
        if small.any():
            alo, ahi, blo, bhi, spent, own = pairs[:, small]
            count = size[small]
            at = np.repeat(np.arange(len(count)), count)
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = (bhi - blo)[at]
            i, j = alo[at] + k // width, blo[at] + k % width
            keep = (own[at] == 0) | (i < j)
            i, j = i[keep], j[keep]
            hit = _popcount(bits[i] ^ bits[j]) <= BUDGET
            found_a.append(i[hit])
            found_b.append(j[hit])
            pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        c = ones_before(depth)
        alo, ahi, blo, bhi, spent, own = pairs
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        none = np.zeros_like(own)
        cross = own == 0
        children = [np.array([alo, am, blo, bm, spent, own]), np.array([am, ahi, bm, bhi, spent, own]),
                    np.array([alo, am, bm, bhi, spent + 1, none]),
                    np.array([am, ahi, blo, bm, spent + 1, none])[:, cross]]
        stack.append((depth + 1, np.concatenate(children, axis=1)))
    return np.concatenate(found_a), np.concatenate(found_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions over the links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _unit_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (block, value, i, j, side, bits, fp) sorted by unit -> links (a, b) between fingerprints."""
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        unit = rows.groupby(["block", "value", "i", "j"], sort=False).ngroup().to_numpy()
        bits = rows["bits"].to_numpy(np.int64).view(np.uint64)
        order = np.lexsort((bits, rows["side"].to_numpy(), unit))
        bits, fp = bits[order], rows["fp"].to_numpy(np.int64)[order]
        width = np.array([w for _, w in BLOCKS])[rows["block"].to_numpy()[order]]
        a, b = trie_links(bits, rows["side"].to_numpy()[order], unit[order], width)
        label = forest(len(fp), a, b)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[moved], "b": fp[label[moved]]})

    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= BATCH_ROWS:
            rows = pd.concat(held, ignore_index=True)
            last = (rows[["block", "value", "i", "j"]] == rows.iloc[-1][["block", "value", "i", "j"]]).all(axis=1).to_numpy()
            if not last.all():
                yield links(rows[~last])
                rows = rows[last]
            held, count = [rows], len(rows)
    if count:
        yield links(pd.concat(held, ignore_index=True))


# ---- the join as a Spark job
def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def linked_pairs(prints: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (distinct column ``fp``) within the budget; not every pair, but every connection."""
    n_parts = partitions(prints.sparkSession)
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(_rotated(F.col("fp"), start), 64 - width).alias("value"),
                                _rotated(F.col("fp"), start).alias("bits")) for b, (start, width) in enumerate(BLOCKS)])
    rows = prints.select("fp", F.explode(blocks).alias("x")).select("fp", "x.*")
    sizes = rows.groupBy("block", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cap = min(MOST_CHUNK, max(LEAST_CHUNK, prints.count() * len(BLOCKS) // n_parts))
    sizes = sizes.select("block", "value", F.ceil(F.col("n") / cap).cast("int").alias("chunks"))
    rows = rows.join(sizes, ["block", "value"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    units = other.select("block", F.col("value").cast("int").alias("value"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
                         F.when(F.col("chunk") > F.col("other"), 1).otherwise(0).alias("side"), "bits", "fp")
    dealt = units.repartition(n_parts, "block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j")
    return dealt.mapInPandas(_unit_links, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: root is the smallest node reachable. Large-star and small-star steps until nothing moves.

    Links are few against documents, and there are many rounds: a round has as many tasks as its links need, not one per shuffle
    partition, each with its files and its line in the event log. Links of one task are not shuffled at all."""
    def by_node(rows: DataFrame, low: DataFrame) -> DataFrame:
        # the join would shuffle even a single task's rows
        return rows.join(F.broadcast(low) if tasks == 1 else low, "u")

    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    count, state = edges.count(), None
    while True:
        tasks = max(1, -(-count // ROUND_LINKS))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
        large = by_node(both, low).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = by_node(large, low).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        edges = cut_lineage(small.unionByName(low.select("u", F.col("low").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).coalesce(tasks)
        count, state = now[0], now


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable."""
    ship(docs.sparkSession)
    prints = cut_lineage(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_fingerprints, "doc_id bigint, fp bigint"))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(linked_pairs(nodes.select("fp")))
    member = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    member = member.join(nodes.withColumnRenamed("fp", "node"), "node")
    named = member.join(member.groupBy("root").agg(F.min("first").alias("named")), "root").select(F.col("node").alias("fp"), "named")
    label = nodes.join(named, "fp", "left").select("fp", F.coalesce("named", "first").alias("component_id"))
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = classes) -> DataFrame:
    """One row of each component, that of the smallest id; rows without an id stay. All columns unchanged."""
    kept = classes(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("kept_id"))
    named = rows.join(kept, "kept_id").dropDuplicates(["kept_id"]).select("doc.*")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
