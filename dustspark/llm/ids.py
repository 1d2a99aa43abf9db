"""Token ids in compressed files: an adaptive context-mixing range coder over independent, checksummed blocks.

Documents in ascending order of their ids are cut into ranges (files), frames and blocks of BLOCK ids. A block starts with
fresh models and stands alone. The last id seen after the same two ids (order 2), or else after the same one (order 1), is
the candidate. Whether it is right is one binary event; its probability is mixed in the logistic domain from the hit rates by
confidence of either order and of the case (order 0), with weights that learn from each outcome. A wrong candidate is followed
by the id itself, under the adaptive order-0 distributions of its high byte and its low byte. All arithmetic is in integers, so any machine decodes alike.

The blocks of a frame are coded side by side, one numpy lane each. A frame is one row of a Parquet file: document ids and
lengths, block lengths, CRC-32 of each block's ids, coded bytes. Parquet serves as the container because Spark writes it to any
shared store and commits it as a whole, and reads it by byte ranges.

Null or empty text: the end id alone. Null document ids come last. Repeated rows are written like others, equal ones in any
order. Empty table: no frame.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dustspark.llm.common import partitions
from dustspark.llm.packing import tokenise
from dustspark.llm.ranges import range_of
from dustspark.llm.tokens import vocabulary
from dustspark.session import scratch

VOCABULARY = "word_bpe_49k.json"
BLOCK = 2048
LANES = 4096
CONTEXT_BITS = 11
TOTAL_BITS = 16
CONFIDENT = 7  # most hits in a row that are told apart

_S16, _S48 = np.uint64(16), np.uint64(48)
_TOP = np.uint64(1 << 48)
_BOTTOM = np.uint64(1 << 32)
_ZERO = np.uint64(0)
_MASK = (1 << CONTEXT_BITS) - 1


def _squash_table() -> np.ndarray:
    """Logistic of -2047..2047 (256 per unit) in 12 bits, by lines between 33 values, at least 32 from either end."""
    knots = [round(4096 / (1 + 2.718281828459045 ** (-k / 2))) for k in range(-16, 17)]
    x = np.arange(-2048, 2048) + 2048
    lo, w = x >> 7, x & 127
    k = np.array(knots)
    return np.clip((k[lo] * (128 - w) + k[lo + 1] * w + 64) >> 7, 32, 4064).astype(np.int32)


SQUASH = _squash_table()
STRETCH = np.searchsorted(SQUASH, np.arange(4096)).clip(0, 4095).astype(np.int32) - 2048


class _Coder:
    """Range of many lanes, the same for both directions: 64-bit low, carries avoided by shortening the range, 16-bit words."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, (1 << 64) - 1, np.uint64)

    def settle(self, i: np.ndarray | None, low: np.ndarray, size: np.ndarray) -> None:
        """Stores the new state of lanes ``i`` (None: all from the first) and moves words while the top is settled or the range short."""
        while True:
            settled = (low ^ (low + size)) < _TOP
            need = np.flatnonzero(settled | (size < _BOTTOM))
            if not len(need):
                break
            l, s = low[need], size[need]
            s = np.where(settled[need], s, (~l + np.uint64(1)) & np.uint64((1 << 32) - 1))
            self.word(need if i is None else i[need], l)
            low[need] = l << _S16
            size[need] = s << _S16
        if i is None:
            self.low[:len(low)], self.range[:len(low)] = low, size
        else:
            self.low[i], self.range[i] = low, size

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        raise NotImplementedError


class _Writer(_Coder):
    def __init__(self, lanes: int, words: int) -> None:
        super().__init__(lanes)
        self.out = np.zeros(lanes * words, np.uint16)
        self.begin = np.arange(lanes) * words
        self.at = self.begin.copy()

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        self.out[at] = low >> _S48
        self.at[lanes] = at + 1

    def event(self, right: np.ndarray, p: np.ndarray) -> None:
        n = len(p)
        r = self.range[:n] >> _S16
        cut = r * p
        low = self.low[:n] + np.where(right, _ZERO, cut)
        self.settle(None, low, np.where(right, cut, (r << _S16) - cut))

    def symbols(self, i: np.ndarray, *parts: tuple[np.ndarray, np.ndarray]) -> None:
        low, size = self.low[i], self.range[i]
        for cum, freq in parts:
            r = size >> _S16
            low = low + r * cum.view(np.uint64)
            size = r * freq.view(np.uint64)
        self.settle(i, low, size)

    def finish(self) -> list[bytes]:
        lanes = np.arange(len(self.low))
        for _ in range(4):
            self.word(lanes, self.low)
            self.low <<= _S16
        return [self.out[a:b].astype("<u2").tobytes() for a, b in zip(self.begin.tolist(), self.at.tolist(), strict=True)]


class _Reader(_Coder):
    def __init__(self, coded: list[bytes]) -> None:
        super().__init__(len(coded))
        words = max(len(c) // 2 for c in coded) + 8
        table = np.zeros((len(coded), words), np.uint16)
        for k, c in enumerate(coded):
            table[k, :len(c) // 2] = np.frombuffer(c, "<u2")
        self.at = np.arange(len(coded)) * words + 4
        first = table[:, :4].astype(np.uint64)
        self.code = (first[:, 0] << _S48) | (first[:, 1] << np.uint64(32)) | (first[:, 2] << _S16) | first[:, 3]
        self.words = table.reshape(-1)

    def word(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = (self.code[lanes] << _S16) | self.words[at]
        self.at[lanes] = at + 1

    def event(self, p: np.ndarray) -> np.ndarray:
        n = len(p)
        low, r = self.low[:n], self.range[:n] >> _S16
        cut = r * p
        right = self.code[:n] - low < cut
        self.settle(None, low + np.where(right, _ZERO, cut), np.where(right, cut, (r << _S16) - cut))
        return right

    def symbols(self, i: np.ndarray, *models: _Bytes) -> list[np.ndarray]:
        low, size, code, out = self.low[i], self.range[i], self.code[i], []
        for m in models:
            r = size >> _S16
            s = m.find(i, np.minimum((code - low) // r, np.uint64((1 << TOTAL_BITS) - 1)).view(np.int64))
            cum, freq = m.of(i, s)
            low = low + r * cum.view(np.uint64)
            size = r * freq.view(np.uint64)
            out.append(s)
        self.settle(i, low, size)
        return out


class _Bytes:
    """Order-0 distribution of a byte per lane, renewed at growing steps."""

    def __init__(self, lanes: int) -> None:
        self.count = np.zeros(lanes * 256, np.int64)
        self.cum = np.zeros((lanes, 257), np.int64)
        self.flat = self.cum.reshape(-1)
        self.renew()

    def renew(self) -> None:
        count = self.count.reshape(-1, 256)
        freq = 32 + count * ((1 << TOTAL_BITS) - 256 * 32) // np.maximum(count.sum(1, keepdims=True), 1)
        np.cumsum(freq, axis=1, out=self.cum[:, 1:])
        self.cum[:, 256] = 1 << TOTAL_BITS

    def of(self, i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = i * 257 + s
        low = self.flat[at]
        return low, self.flat[at + 1] - low

    def find(self, i: np.ndarray, v: np.ndarray) -> np.ndarray:
        base = i * 257
        at = base.copy()
        for step in (128, 64, 32, 16, 8, 4, 2, 1):
            at += (self.flat[at + step] <= v) * step
        return at - base


class _Model:
    """Candidate and its probability for every lane; coder and decoder take the same steps. Table entries are id * 8 + confidence."""

    def __init__(self, lanes: int) -> None:
        size = 1 << CONTEXT_BITS
        self.base = np.arange(lanes) << CONTEXT_BITS
        self.one = np.full(lanes * size, -8, np.int32)  # after one id
        self.two = np.full(lanes * size, -8, np.int32)  # after two ids
        #: by lane and place: 0-7 and 8-15 hit rates by confidence of order 1 and 2, 16-23 unused by either, 24-27 by case
        self.rate = np.full(lanes * 32, 1 << 14, np.int32)
        self.weight = [np.full(lanes * 4, 22000, np.int32) for _ in range(3)]
        self.row = np.arange(lanes)
        self.high, self.low = _Bytes(lanes), _Bytes(lanes)
        self.a = np.zeros(lanes, np.int64)  # the id before, times an odd number
        self.b = np.zeros(lanes, np.int64)  # the one before that

    def look(self, n: int) -> np.ndarray:
        """Sets the candidates (-1: none) and gives the probability that they are right, in 16 bits."""
        a, b, base = self.a[:n], self.b[:n], self.base[:n]
        self.at1 = base + ((a >> 4) & _MASK)
        self.at2 = base + (((a + b * 3) >> 5) & _MASK)
        self.e1, self.e2 = self.one[self.at1], self.two[self.at2]
        c1, c2 = self.e1 >> 3, self.e2 >> 3
        has2 = self.e2 >= 0
        self.first = np.where(has2, c2, c1)
        # cases: 0 order 1 or none, 1 order 2 only, 2 both differ, 3 both agree
        kind = has2 * (1 + (self.e1 >= 0) + (c1 == c2))
        use1 = (kind == 0) | (kind == 3)
        row = self.row[:n]
        r = row * 32
        self.r1 = r + np.where(use1, self.e1 & 7, 16)
        self.r2 = r + np.where(has2, 8 + (self.e2 & 7), 17)
        self.r0 = r + 24 + kind
        self.w = row * 4 + kind
        rate = self.rate
        self.s = [STRETCH[rate[self.r1] >> 4] * use1, STRETCH[rate[self.r2] >> 4] * has2, STRETCH[rate[self.r0] >> 4]]
        self.weights = [w[self.w] for w in self.weight]
        mixed = (self.s[0] * self.weights[0] + self.s[1] * self.weights[1] + self.s[2] * self.weights[2]) >> 16
        self.p = SQUASH[np.minimum(np.maximum(mixed, -2047), 2047) + 2048]
        return (self.p << 4).astype(np.uint64)

    def learn(self, right: np.ndarray) -> None:
        goal = right * np.int32(65535)
        error = (goal >> 4) - self.p
        for w, old, s in zip(self.weight, self.weights, self.s, strict=True):
            w[self.w] = np.minimum(np.maximum(old + ((s * error) >> 10), -65536), 65536)
        for r in (self.r1, self.r2, self.r0):
            old = self.rate[r]
            self.rate[r] = old + ((goal - old) >> 5)

    def learn_id(self, x: np.ndarray) -> None:
        n = len(x)
        y = (x << 3).astype(np.int32)
        for table, at, e in ((self.one, self.at1, self.e1), (self.two, self.at2, self.e2)):
            table[at] = np.where((e >> 3) == x, np.minimum(e + 1, y + CONFIDENT), y)
        self.b[:n] = self.a[:n]
        self.a[:n] = x * 40503

    def learn_literal(self, j: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        self.high.count[j * 256 + high] += 1
        self.low.count[j * 256 + low] += 1


def _renewals(longest: int) -> set[int]:
    steps, t = set(), 8
    while t < longest:
        steps.add(t)
        t += min(256, max(8, t // 2))
    return steps


def _active(lengths: np.ndarray) -> np.ndarray:
    """How many of the lanes, longest first, have an id at each step."""
    return np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each block of ids (below 65,536, at least one each)."""
    lengths = np.array([len(b) for b in blocks])
    order = np.argsort(-lengths, kind="stable")
    active = _active(lengths[order])
    columns = np.zeros((len(active), len(blocks)), np.uint16)
    for lane, k in enumerate(order.tolist()):
        columns[:lengths[k], lane] = blocks[k]
    model, out, renew = _Model(len(blocks)), _Writer(len(blocks), len(active) * 3 + 16), _renewals(len(active))
    for t, n in enumerate(active.tolist()):
        x = columns[t, :n].astype(np.int64)
        p = model.look(n)
        right = model.first == x
        out.event(right, p)
        model.learn(right)
        j = np.flatnonzero(~right)
        high, low = x[j] >> 8, x[j] & 255
        out.symbols(j, model.high.of(j, high), model.low.of(j, low))
        model.learn_literal(j, high, low)
        model.learn_id(x)
        if t in renew:
            model.high.renew()
            model.low.renew()
    coded = out.finish()
    return [coded[lane] for lane in np.argsort(order).tolist()]


def decode_blocks(lengths: list[int], coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block."""
    sizes = np.array(lengths)
    order = np.argsort(-sizes, kind="stable")
    active = _active(sizes[order])
    columns = np.zeros((len(active), len(coded)), np.uint16)
    model, source, renew = _Model(len(coded)), _Reader([coded[k] for k in order.tolist()]), _renewals(len(active))
    for t, n in enumerate(active.tolist()):
        right = source.event(model.look(n))
        model.learn(right)
        x = model.first.astype(np.int64)
        j = np.flatnonzero(~right)
        high, low = source.symbols(j, model.high, model.low)
        x[j] = high << 8 | low
        model.learn_literal(j, high, low)
        model.learn_id(x)
        columns[t, :n] = x
        if t in renew:
            model.high.renew()
            model.low.renew()
    return [columns[:sizes[order[lane]], lane] for lane in np.argsort(order).tolist()]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# ---- files
FRAME = ("range int, frame int, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, block_lengths array<int>, "
         "block_crc32 array<bigint>, blocks array<binary>")


def write(docs: DataFrame, folder: str, path: str | None = None, block: int = BLOCK, lanes: int = LANES) -> None:
    """Encodes every text and writes the frames in ascending order of doc_id within each range."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames: list[tuple] = []  # (range, frame, documents) that are not coded yet
        last, number, waiting = None, 0, 0

        def flush() -> pd.DataFrame:
            cut, rows = [], []
            for place, k, held in frames:
                ids = np.frombuffer(b"".join(b for _, b in held), "<u2")
                parts = [ids[i:i + block] for i in range(0, len(ids), block)]
                rows.append([place, k, len(ids), [d for d, _ in held], [len(b) // 2 for _, b in held], [len(x) for x in parts], [checksum(x) for x in parts]])
                cut.append(parts)
            coded = iter(encode_blocks([x for parts in cut for x in parts]))
            for row, parts in zip(rows, cut, strict=True):
                row.append([next(coded) for _ in parts])
            frames.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in FRAME.split(", ")])
        for batch in batches:
            for place, doc_id, ids in zip(batch["range"], batch["doc_id"], batch["ids"], strict=True):
                if not frames or place != last:
                    number = number + 1 if place == last else 0
                    frames.append((place, number, []))
                last = place
                frames[-1][2].append((None if pd.isna(doc_id) else int(doc_id), ids))
                waiting += len(ids) // 2
                if waiting >= block * lanes:
                    yield flush()
                    waiting = 0
        if frames:
            yield flush()
    ids = tokenise(docs, path or vocabulary(VOCABULARY))
    dealt = ids.withColumn("range", range_of(docs, "doc_id", partitions(docs.sparkSession)))
    dealt = dealt.repartition(partitions(docs.sparkSession), "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_last())
    dealt.select("range", "doc_id", "ids").mapInPandas(run, FRAME).write.parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, its ids.

    Frames are placed by running sums in two levels: over the ranges, then over the frames of a range."""
    frames = spark.read.schema(FRAME).parquet(folder)
    sizes = frames.select("range", "frame", "n_ids")
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    starts = sizes.select("range", "frame", (F.sum("n_ids").over(Window.partitionBy("range").orderBy("frame")) - F.col("n_ids")).alias("inside"))
    starts = starts.join(ranges, "range").select("range", "frame", (F.col("base") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: list = []
            for k, row in enumerate(batch.itertuples(index=False)):
                held.append(row)
                if k + 1 < len(batch) and sum(len(r.blocks) for r in held) < LANES:
                    continue
                yield decoded(held)
                held = []

    def decoded(rows: list) -> pd.DataFrame:
        coded = [bytes(c) for r in rows for c in r.blocks]
        blocks = decode_blocks([int(n) for r in rows for n in r.block_lengths], coded)
        for x, want in zip(blocks, (int(c) for r in rows for c in r.block_crc32), strict=True):
            if checksum(x) != want:
                raise ValueError("a block differs from its checksum")
        left, out = iter(blocks), []
        for row in rows:
            ids = np.concatenate([next(left) for _ in row.blocks])
            lengths = np.array(row.doc_lengths, np.int64)
            inner = np.cumsum(lengths) - lengths
            raw = ids.astype("<u4").tobytes()
            frame = pd.DataFrame({
                "doc_id": pd.array([None if d is None or d != d else int(d) for d in row.doc_ids], dtype="Int64"), "start": int(row.first) + inner,
                "n_tokens": lengths, "ids_crc32": [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(inner.tolist(), lengths.tolist(), strict=True)]})
            if with_ids:
                frame["ids"] = [ids[a:a + n].astype(np.int32) for a, n in zip(inner.tolist(), lengths.tolist(), strict=True)]
            out.append(frame)
        return pd.concat(out, ignore_index=True)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return frames.join(starts, ["range", "frame"]).mapInPandas(run, schema)


def round_trip(docs: DataFrame, with_ids: bool = True) -> DataFrame:
    """Writes the ids to a fresh shared folder and reads them back."""
    spark = docs.sparkSession
    folder = f"{scratch(spark)}/ids"
    write(docs, folder)
    return read(spark, folder, with_ids)
