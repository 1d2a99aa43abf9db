"""SentencePiece BPE ids and texts, by vectorised merge rounds.

A text is cut into words where a space follows something else; no piece of the vocabulary reaches over such a place, so words
merge alone, and each distinct word of a turn (Arrow's dictionary) is merged once. They lie in one flat array of symbols. A round
takes each word's least pair rank (``minimum.reduceat``), merges that word's pairs of this rank at once, from the left and
without overlap, looks up the two pairs beside each merge, and compacts the array; words without a pair left go out.

Merging equal pairs at once gives the library's ids only where a merge can't make a pair that ranks as high: this is checked
against all pairs of the vocabulary when it is read. At the other ranks (pieces of spaces alone share one) a word's leftmost pair
merges alone; a word of over ``LONG`` symbols leaves the rounds there and ends in ``one_by_one``, the same order with a heap, so
that no text takes more than n log n. Symbols that are no piece become byte pieces.

Ids are little-endian 32-bit binaries, the begin id first and the end id last. Null and empty texts have these two ids, and
decode to an empty text. U+2581 counts as a space and comes back as one, as in the library. All other columns are kept;
rows that are equal or have no id are encoded like others. The tokenizer file must be readable by every worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import ship
from dustspark.llm.tokens import vocabulary

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: bytes that a turn encodes
TURN_BYTES = 1 << 22
#: symbols of a word that merges one pair a round
LONG = 256
_NONE = np.int32(np.iinfo(np.int32).max)
#: kinds of pieces in the model file (fixed values)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_LOADED: dict[str, PieceModel] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at:at + size]
            at += size


class PieceModel:
    """A vocabulary file: pieces, pair ranks, and merging and joining of many words at once."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        pieces = [dict(_fields(v)) for f, v in parts if f == 1]
        trainer, normal = (dict(_fields(next(v for f, v in parts if f == n))) for n in (2, 3))
        self.texts = [p.get(1, b"").decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        scores = np.array([np.frombuffer(p.get(2, bytes(4)), "<f4")[0] for p in pieces])
        if (trainer.get(3), trainer.get(35)) != (2, 1) or USER in kinds or UNUSED in kinds:
            raise ValueError(f"{path}: not a BPE model with byte pieces and without user-defined pieces")
        if normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24):
            raise ValueError(f"{path}: only the identity normaliser with a leading space is known")
        self.n = len(pieces)
        self.begin, self.end, self.unknown = (trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0))
        self.bytes = np.zeros(256, np.int32)
        for k in np.flatnonzero(np.array(kinds) == BYTE):
            self.bytes[int(self.texts[k][3:5], 16)] = k
        self._pairs([k for k in range(self.n) if kinds[k] == NORMAL], scores)
        # bytes of the pieces in one array, for decoding
        raw = [self.texts[k].replace(SPACE, " ").encode() if kinds[k] == NORMAL else bytes([int(self.texts[k][3:5], 16)]) if kinds[k] == BYTE
               else b"" if kinds[k] == CONTROL else trainer.get(44, " ⁇ ".encode()) for k in range(self.n)]
        self.is_byte = np.array(kinds) == BYTE
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw])
        self.at = np.cumsum(self.size) - self.size

    def _pairs(self, normal: list[int], scores: np.ndarray) -> None:
        """Every pair of symbols that is a piece, with its rank; a character that is no piece is a symbol above all ids."""
        ids = {self.texts[k]: k for k in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in ids):
            raise ValueError("a piece reaches over the begin of a word")
        self.symbol = (np.arange(0x110000) + self.n).astype(np.int32)
        for x, k in ids.items():
            if len(x) == 1:
                self.symbol[ord(x)] = k
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        rows = []
        for x, k in ids.items():
            for cut in range(1, len(x)):
                a, b = (self.symbol[ord(y)] if len(y) == 1 else ids.get(y) for y in (x[:cut], x[cut:]))
                if a is not None and b is not None:
                    rows.append((int(a) << 32 | int(b), k))
        rows.sort()
        self.keys, self.whole = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)
        self.ranks = rank[self.whole]
        self.unsafe = self._unsafe(rank)
        self.lookup: dict[int, tuple[int, int]] = {}

    def _unsafe(self, rank: np.ndarray) -> np.ndarray:
        """By rank, whether a merge of this rank can make a pair that ranks as high, so that equal pairs may not merge at once.

        A merge of a and b beside c can only if ab and c are a pair of such a rank while b and c are none that goes first.
        """
        unsafe = np.zeros(rank.max() + 2, bool)
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        order = np.argsort(self.whole, kind="stable")
        first, last = (np.searchsorted(self.whole[order], np.arange(self.n + 1), side) for side in ("left", "right"))
        for merged, beside in ((left, 1), (right, 0)):
            own = rank[np.minimum(merged, self.n - 1)]
            for k in np.flatnonzero((merged < self.n) & (self.ranks <= own) & ~unsafe[own]):
                made = order[first[merged[k]]:last[merged[k]]]
                if len(made):
                    r = self.pair(right[made], np.full(len(made), right[k]))[0] if beside else self.pair(np.full(len(made), left[k]), left[made])[0]
                    unsafe[own[k]] |= not (r < own[k] if beside else r <= own[k]).all()
        return unsafe

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; the rank of a pair that is no piece is ``_NONE``."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        return np.where(known, self.ranks[at], _NONE), self.whole[at]

    def one_by_one(self, symbols: list[int]) -> list[int]:
        """The merges in their plain order: the best pair, the leftmost of equals, until none is left."""
        n = len(symbols)
        symbols = list(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        if not self.lookup:
            self.lookup.update(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.whole.tolist(), strict=True), strict=True))

        def push(i: int) -> None:
            if i >= 0 and after[i] >= 0:
                found = self.lookup.get(symbols[i] << 32 | symbols[after[i]])
                if found:
                    heapq.heappush(heap, (found[0], i, symbols[i], symbols[after[i]], found[1]))

        heap: list[tuple] = []
        for i in range(n):
            push(i)
        gone = [False] * n
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = whole, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(before[i])
            push(i)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def merge(self, symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words, one after another, when no pair is left, and the begin of each word in them and their end."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.arange(len(size))  # the words that the array still holds

        def ranked(symbols: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rank, whole = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
            rank[:-1], whole[:-1] = self.pair(symbols[:-1], symbols[1:])
            rank[np.cumsum(size) - 1] = _NONE  # no pair leaves its word
            return rank, whole

        rank, whole = ranked(symbols, size)
        while len(word):
            starts = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, starts)
            single = self.unsafe[np.minimum(best, len(self.unsafe) - 1)]
            for k in np.flatnonzero(single & (size > LONG)):
                ended = np.array(self.one_by_one(symbols[starts[k]:starts[k] + size[k]].tolist()), np.int32)
                done.append((word[k:k + 1], np.array([len(ended)]), ended))
                best[k] = -1
            none = best == _NONE
            if none.any():
                done.append((word[none], size[none], symbols[np.repeat(none, size)]))
            stay = (best != _NONE) & (best != -1)
            if not stay.all():
                held = np.repeat(stay, size)
                symbols, rank, whole = symbols[held], rank[held], whole[held]
                word, size, best, single = word[stay], size[stay], best[stay], single[stay]
                if not len(word):
                    break
            owner = np.repeat(np.arange(len(size)), size)
            hit = np.flatnonzero(rank == best[owner])
            # of a run of neighbouring pairs every second one, from the left
            first = np.concatenate([[True], np.diff(hit) != 1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            keep = (np.arange(len(hit)) - run) % 2 == 0
            keep &= ~single[owner[hit]] | np.concatenate([[True], np.diff(owner[hit]) != 0])
            hit = hit[keep]
            symbols[hit] = whole[hit]
            left = np.ones(len(symbols), bool)
            left[hit + 1] = False
            size = size - np.bincount(owner[hit], minlength=len(size))
            last = np.cumsum(size) - 1
            symbols, rank, whole = symbols[left], rank[left], whole[left]
            now = hit - np.arange(len(hit))
            for side in (now, now[now > 0] - 1):
                side = side[side < len(symbols) - 1]
                rank[side], whole[side] = self.pair(symbols[side], symbols[side + 1])
            rank[last] = _NONE
        # back to the order of the words
        words, sizes, flat = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(words)
        at = np.cumsum(sizes) - sizes
        return _gather(flat, at[order], sizes[order])

    def ids(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, a character that is no piece as its bytes' pieces, and where the words begin and end in them."""
        strange = np.flatnonzero(symbols >= self.n)
        if not len(strange):
            return symbols, starts
        raw = [self.bytes[list(chr(c).encode())] for c in (symbols[strange] - self.n).tolist()]
        count = np.ones(len(symbols), np.int64)
        count[strange] = [len(x) for x in raw]
        ends = np.concatenate([[0], np.cumsum(count)])
        out = np.repeat(symbols, count)
        out[np.repeat(count > 1, count) | np.repeat(symbols >= self.n, count)] = np.concatenate(raw)
        return out, ends[starts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts, without begin and end."""
        lines = [(" " + t.replace(SPACE, " ")).encode() if t else b"" for t in texts]
        data = b"".join(lines)
        if not data:
            return [b""] * len(lines)
        edges = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
        space = np.frombuffer(data, np.uint8) == 32
        begin = space & np.concatenate([[True], ~space[:-1]])
        begin[edges[:-1][edges[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        offsets = np.append(starts, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)
        raw = distinct.buffers()[2].to_pybytes()[:ends[-1]]
        size = np.add.reduceat((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, ends[:-1]).astype(np.int64)
        points = np.frombuffer(raw.decode().replace(" ", SPACE).encode("utf-32-le"), "<u4")
        flat, at = self.ids(*self.merge(self.symbol[points], size))
        which = words.indices.to_numpy()
        ids, begins = _gather(flat.astype("<u4"), at[which], at[which + 1] - at[which])
        cut = begins[np.searchsorted(starts, edges)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids: pieces joined, byte pieces as UTF-8 with a replacement for each byte that is none, without the leading space."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        size = self.size[flat]
        ends = np.cumsum(size)
        whole = self.raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[flat] - (ends - size), size)].tobytes()
        stop = np.concatenate([[0], ends])[np.cumsum([len(x) // 4 for x in ids])] if ids else []
        out, start = [], 0
        for x, end in zip(ids, np.asarray(stop).tolist(), strict=True):
            inside = np.trim_zeros(self.size[np.frombuffer(x, "<u4")])
            try:
                text = whole[start:end].decode() if inside.all() else self._decode_broken(np.frombuffer(x, "<u4"))
            except UnicodeDecodeError:
                text = self._decode_broken(np.frombuffer(x, "<u4"))
            # the first piece that is not a control sign loses its space, a byte does not
            first = next((k for k in np.frombuffer(x, "<u4", min(len(x) // 4, 8)).tolist() if self.size[k]), None)
            out.append(text[1:] if first is not None and not self.is_byte[first] and first != self.unknown and text.startswith(" ") else text)
            start = end
        return out

    def _decode_broken(self, ids: np.ndarray) -> str:
        def piece(k: int) -> bytes:
            return self.raw[self.at[k]:self.at[k] + self.size[k]].tobytes()

        out, held = [], b""
        for k in [*ids.tolist(), None]:
            if k is not None and self.is_byte[k]:
                held += piece(k)
                continue
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(held[:n].decode())
                        held = held[n:]
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    held = held[1:]
            if k is not None:
                out.append(piece(k).decode())
        return "".join(out)


def _gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` that begin at ``at``, one after another, and their begins and the end."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends[-1]) + np.repeat(at - ends[:-1], size)], ends


def model(path: str) -> PieceModel:
    """The worker's model of a file; kept for the next tasks of the worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def _turns(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of rows of about ``TURN_BYTES``; a longer row is a slice of its own."""
    turn = np.cumsum(sizes) // TURN_BYTES
    edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _mapped(docs: DataFrame, given: str, made: str, kind: pa.DataType, work: Callable[[list], list]) -> DataFrame:
    """``docs`` with the column ``made``, computed from ``given`` a turn at a time; a column of that name is replaced."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != made]).alias("row"), F.col(f"`{given}`").alias("given"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = column.cast(pa.binary()).fill_null(b"")
            sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int32, len(sizes) + 1, 4 * sizes.offset)) if len(sizes) else np.zeros(0, int)
            for a, b in _turns(sizes):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(work(part.column(1).to_pylist()), kind)], ["row", made])

    schema = rows.drop("given").schema.add(made, {pa.binary(): "binary", pa.string(): "string"}[kind])
    return rows.mapInArrow(run, schema).select("row.*", made)


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids``: the ids of the whole text between the begin and the end id."""
    path = path or vocabulary(VOCABULARY)

    def work(texts: list) -> list:
        m = model(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (m.begin, m.end))
        return [begin + x + end for x in m.encode(texts)]
    return _mapped(docs.withColumn(text, F.col(f"`{text}`").cast("string")), text, "ids", pa.binary(), work)


def decode(docs: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded``: the text of the ids; null ids have an empty one."""
    path = path or vocabulary(VOCABULARY)
    return _mapped(docs, ids, "decoded", pa.string(), lambda some: model(path).decode([x or b"" for x in some]))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    known = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path=path).drop("text"), path=path)
    return known.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
