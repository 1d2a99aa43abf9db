"""Packing documents into windows of ids by the sum-of-squares rule.

Online and per task: the level array N[h] counts the open windows filled to h. A piece of s ids goes to the level h (or to a new
window) for which the sum of the squares of N is smallest afterwards; a filled window leaves. Documents longer than a window
are cut into full windows and a rest, and only the rest is placed. When a task's documents end, the open windows are
poured together, emptiest into fullest, cutting pieces; the last one is cut into windows of powers of two, which need no
padding. So nothing is padded, and only the few windows open at the end are cut more than their length demands.

Documents are dealt to tasks by a hash of the id and the length, and ordered by it, so a repeated task packs alike. A task
holds its open windows only.

Null or empty text: the end id alone. Repeated rows are packed like others. Null ids are kept. Empty table: no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import partitions, ship
from dustspark.llm.tokens import END_ID, MEMO, encoder, vocabulary

WINDOW = 2048
VOCABULARY = "byte_bpe_50k.json"
TEXT_CHARS = 1 << 21
PACKING_MEMO = 600_000
#: ids of full windows that are kept before their rows leave the task
FLUSH_IDS = 1 << 21


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """(doc_id, ids): ids of the whole text and the end id, 16 bits each, little-endian."""
    ship(docs.sparkSession)
    tail = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # long texts are encoded in several turns
            turn = (batch["text"].str.len().fillna(0).cumsum() // TEXT_CHARS).to_numpy()
            for k in np.unique(turn):
                part = batch[turn == k]
                ids = encoder(path, memo).encode([t if isinstance(t, str) else None for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": [x + tail for x in ids]})
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id bigint, ids binary")


class Packer:
    """Open windows by level. A window is a list of pieces (key, start, length); ``full`` collects those that are done."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # the level array; the two ends stay zero
        self.open: dict[int, list[list]] = defaultdict(list)
        self.full: list[list] = []

    def place(self, key: object, start: int, size: int) -> None:
        n, b = self.count, self.window
        # change of the sum of squares, halved: N[h+s] - N[h] + 1, without the terms of an empty or a full window
        change = n[size:] - n[:b - size + 1] + 1.0
        change[0] -= 0.5
        change[-1] -= 0.5
        change[1:][n[1:b - size + 1] == 0] = np.inf
        h = len(change) - 1 - int(np.argmin(change[::-1]))
        pieces = self.open[h].pop() if h else []
        pieces.append((key, start, size))
        if h:
            n[h] -= 1
        if h + size == b:
            self.full.append(pieces)
        else:
            n[h + size] += 1
            self.open[h + size].append(pieces)

    def add(self, key: object, length: int) -> None:
        whole = length // self.window * self.window
        self.full += [[(key, s, self.window)] for s in range(0, whole, self.window)]
        if length > whole:
            self.place(key, whole, length - whole)

    def close(self) -> None:
        """Pours the open windows together; the last becomes windows of powers of two."""
        # a stack with the fullest windows on top: they are topped up by the pieces of the emptiest, which lie below
        waiting = deque(p for h in sorted(self.open) for w in self.open[h] for p in w)
        total = sum(p[2] for p in waiting)
        sizes = [self.window] * (total // self.window)
        sizes += [1 << b for b in range(self.window.bit_length() - 1, -1, -1) if total % self.window >> b & 1]
        for size in sizes:
            pieces: list[tuple] = []
            room = size
            while room:
                key, start, length = waiting.pop() if waiting[-1][2] <= room else waiting.popleft()
                used = min(room, length)
                pieces.append((key, start, used))
                room -= used
                if used < length:
                    waiting.appendleft((key, start + used, length - used))
            self.full.append(pieces)
        self.open.clear()
        self.count[:] = 0


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, its ids."""
    path = path or vocabulary(VOCABULARY)
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
              + (", ids array<int>" if with_ids else ""))

    def rows(packer: Packer, held: dict, made: int, base: int) -> pd.DataFrame:
        out = []
        for k, pieces in enumerate(packer.full):
            offset = 0
            for key, start, length in pieces:
                doc_id, ids = held[key]
                part = np.frombuffer(ids, "<u2", length, 2 * start).astype("<u4")
                out.append((doc_id, start, length, zlib.crc32(part.tobytes()), len(ids) // 2, base + made + k, offset, *([part.astype(np.int32)] if with_ids else [])))
                offset += length
        packer.full.clear()
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer, held, key, made, gathered = Packer(window), {}, 0, 0, 0

        def flush() -> pd.DataFrame:
            nonlocal made, held
            n = len(packer.full)
            frame = rows(packer, held, made, base)
            made += n
            waiting = {p[0] for ws in packer.open.values() for w in ws for p in w}
            held = {k: v for k, v in held.items() if k in waiting}
            return frame

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], batch["ids"], strict=True):
                held[key] = (None if pd.isna(doc_id) else int(doc_id), ids)
                packer.add(key, len(ids) // 2)
                key += 1
                gathered += len(ids) // 2
                if gathered >= FLUSH_IDS:
                    yield flush()
                    gathered = 0
        packer.close()
        if packer.full:
            yield flush()

    ids = tokenise(docs, path, memo=PACKING_MEMO).withColumn("place", F.xxhash64("doc_id", F.octet_length("ids")))
    dealt = ids.repartition(partitions(docs.sparkSession), "place").sortWithinPartitions("place", "doc_id", F.crc32("ids"))
    return dealt.select("doc_id", "ids").mapInPandas(run, schema)
