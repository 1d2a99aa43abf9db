"""Periodic runs of words: maximal stretches with smallest period q and at least max(12, 2 q) words, found by tiles per octave.

Octave k holds the periods from 2^k to below 2^(k+1). A run of such a period matches itself q words on over at least q words,
so one of these places is a multiple of 2^k, a boundary (of 4 in the first octaves, as at least 6 places match). A document is cut, per octave, into tiles of boundaries with a margin on both
sides that overlaps the next tile; tiles are rows, dealt to tasks whatever document they are of, and solved without
each other: at each boundary c the Z-function of the words from c on, and that of the words before c read backwards,
give for all periods of the octave at once how far the words q apart stay equal to the right and left; if both reaches
together have q words, the stretch is a fragment, unless its block is itself a repetition (the Z-function shows it).
Fragments are shuffled by document and period and stitched where they overlap by a period, since then their union has it.

Tiles are made only where a run can be: of the words of a run, all but the last q + 5 begin six words that come again at a
distance of the octave. Six-word hashes mark these places; a false mark costs a tile, and no run is missed at any length.

Null, empty and wordless texts have no word and no run; the collapsed text is empty. Rows without id, equal rows and extra columns
change nothing: a row is one document. Very long documents are many tiles; their words are read in one task, as any text is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dustspark.llm.common import partitions, ship
from dustspark.session import scratch

LEAST, GRAM = 12, 6
#: boundaries of a tile, words that a tile has at least room for
BOUNDARIES, TILE_WORDS = 8, 1024
#: words of tiles and of open documents that leave a task at once
FLUSH_WORDS = 1 << 20
SEED = 0x9E3779B97F4A7C15

Edit = Callable[[int | None, list[bytes]], list[bytes]]
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_DOCUMENT = ("doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
             "runs_sha256 string, collapsed_sha256 string")


# ---- one document
def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # the six ASCII spaces


def numbered(ws: list[bytes]) -> np.ndarray:
    """Words as numbers that are equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int32, len(ws))


def spacing(k: int) -> int:
    """Distance of boundaries; any LEAST words of a period below 8 match themselves over at least LEAST / 2 places."""
    return max(1 << k, 4)


def margin(k: int) -> int:
    return (2 << k) + 16


def zones(ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(octave, begin, end): stretches of places that hold every place of a run of the octave which matches the word a period on."""
    n = len(ids)
    if n < LEAST:
        return
    m = n - GRAM + 1
    h = np.zeros(m, np.uint64)
    for j in range(GRAM):
        h = h * np.uint64(SEED) + ids[j:j + m].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return
    group = np.concatenate([[0], np.cumsum(~same)])
    met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    place, key = order[met], (group * (n + 1) + order)[met]  # rising
    base = key - place
    for k in range(int(n // 2).bit_length()):
        later = key[np.minimum(np.searchsorted(key, key + (1 << k)), len(key) - 1)] - base
        hit = np.zeros(m + 2, np.int8)
        hit[place[(later >= place + (1 << k)) & (later < np.minimum(place + (2 << k), n + 1))] + 1] = 1
        turn = np.diff(hit)
        begins, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        least = min(max(LEAST - q, q) for q in range(1 << k, min(2 << k, LEAST) + 1)) if 1 << k <= LEAST else 1 << k
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a >= least - GRAM + 1:
                yield k, a, b + GRAM - 1


def tiles(ids: np.ndarray) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(octave, place of the first word, first and last boundary in the tile, words): the boundaries of a zone, some at a time."""
    for k, a, b in zones(ids):
        step = spacing(k)
        wide = max(BOUNDARIES * step, TILE_WORDS)
        for x in range(-(-a // step) * step, b, wide):
            last = (min(x + wide, b) - 1) // step * step
            first = max(0, x - margin(k))
            yield k, first, x - first, last - first, ids[first:last + (2 << k) + margin(k)]


def z_function(w: np.ndarray) -> list[int]:
    """For each place, how many words from there on equal the words from the begin on; 0 at the begin."""
    n = len(w)
    z = [0] * n
    left = right = 0
    for i in (np.flatnonzero(w[1:] == w[0]) + 1).tolist() if n else []:
        end = i + 1
        if i < right:
            if z[i - left] < right - i:
                z[i] = z[i - left]
                continue
            end = right
        size = 16
        while end < n:
            part = w[end:end + size]
            differ = part != w[end - i:end - i + len(part)]
            stop = int(differ.argmax())
            if differ[stop]:
                end += stop
                break
            end += len(part)
            size *= 2
        z[i] = end - i
        left, right = i, end
    return z


@lru_cache(maxsize=1 << 16)
def primes(q: int) -> tuple[int, ...]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return (*out, q) if q > 1 else tuple(out)


def solve(w: np.ndarray, k: int, first: int, last: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) in a tile: fragments of runs of octave k at the boundaries from ``first`` to ``last``."""
    low, high, reach = 1 << k, 2 << k, margin(k)
    found: dict[int, list[list[int]]] = {}
    for c in range(first, last + 1, spacing(k)):
        z = z_function(w[c:c + high + reach])
        ahead = np.array(z[:high], np.int64)
        some = np.flatnonzero(ahead[low:]) + low
        # where the words from c on repeat a shorter block throughout, the octave's multiples of its length are no smallest periods
        short = np.flatnonzero((ahead + np.arange(len(ahead)))[1:low] >= high)
        if len(short):
            some = some[some % (short[0] + 1) != 0]
        if not len(some):
            continue
        before = w[max(0, c - reach):c][::-1]
        end = min(len(w), c + high)
        back = z_function(np.concatenate([before, [-1], w[max(0, c - reach):end][::-1]]))
        for q in some.tolist():
            behind = back[len(before) + 1 + end - c - q]
            if behind + z[q] < q or any(z[q // f] >= q - q // f for f in primes(q)):
                continue
            a, b = c - behind, c + q + z[q]
            held = found.setdefault(q, [])
            if held and a <= held[-1][1] - q:
                held[-1][1] = max(held[-1][1], b)
            else:
                held.append([a, b])
    return [(q, a, b) for q, held in found.items() for a, b in held]


def collapse(ws: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run holds after its first period."""
    drop = np.zeros(len(ws) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    drop = np.cumsum(drop)[:-1] > 0
    return b" ".join(w for w, gone in zip(ws, drop.tolist(), strict=True) if not gone)


def report(doc_id: int | None, ws: list[bytes], runs: list[tuple[int, int, int]]) -> tuple[tuple, bytes]:
    """The row of a document whose runs (start, length, period) are known in order, and its collapsed text."""
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    text = collapse(ws, runs) if runs else b" ".join(ws)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    row = (doc_id, len(ws), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
           hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())
    return row, text


# ---- the job
def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({n: "Int64" for n, c in zip(names, schema.split(", "), strict=True) if c.endswith("bigint")})


def detect(docs: DataFrame, edit: Edit | None = None, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: its run counts, its longest run, digests and, if asked for, ``runs`` and the ``collapsed`` text.

    ``edit`` changes a document's words before they are looked at. Documents that can't hold a run are finished where they
    are read; only the others' words and tiles are written, to the shared folder, and shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    done = _DOCUMENT + (f", runs {_RUNS}, collapsed string" if texts else "")
    schema = f"{done}, open bigint, words binary, octave bigint, first bigint, begin bigint, last bigint, ids binary"
    width = len(schema.split(", "))
    tail = len(done.split(", "))

    def result(doc_id: int | None, ws: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
        row, text = report(doc_id, ws, runs)
        return (*row, [{"start": s, "length": n, "period": q} for s, n, q in runs], text.decode()) if texts else row

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ws = words(text)
                if edit:
                    ws = edit(doc_id, ws)
                opened = False
                for k, first, begin, last, ids in tiles(numbered(ws)):
                    opened = True
                    rows.append((*[None] * tail, number, None, k, first, begin, last, ids.tobytes()))
                    held += len(ids)
                    if held > FLUSH_WORDS:
                        yield _frame(rows, schema)
                        rows, held = [], 0
                if opened:
                    rows.append((doc_id, *[None] * (tail - 1), number, b" ".join(ws), *[None] * (width - tail - 2)))
                    number += 1
                    held += 2 * len(ws)
                else:
                    rows.append((*result(doc_id, ws, []), *[None] * (width - tail)))
                    held += 10 + (len(ws) if texts else 0)
            if rows and held > FLUSH_WORDS // 8:
                yield _frame(rows, schema)
                rows, held = [], 0
        if rows:
            yield _frame(rows, schema)

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.open, q, r.first + a, r.first + b) for r in batch.itertuples()
                   for q, a, b in solve(np.frombuffer(r.ids, np.int32), r.octave, r.begin, r.last)]
            yield pd.DataFrame(out, columns=["open", "period", "start", "stop"])

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, runs in zip(batch["doc_id"], batch["words"], batch["found"], strict=True):
                listed = [(int(r["start"]), int(r["length"]), int(r["period"])) for r in runs] if runs is not None else []
                rows.append(result(None if pd.isna(doc_id) else int(doc_id), text.split(b" "), listed))
            yield _frame(rows, done)

    folder = scratch(spark)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scan, schema).write.parquet(folder)
    kept = spark.read.parquet(folder)
    # the tiles of one document lie side by side: deal them anew
    dealt = kept.where("octave IS NOT NULL").select("open", "octave", "first", "begin", "last", "ids")
    dealt = dealt.repartition(partitions(spark), "open", "octave", "first")
    fragments = dealt.mapInPandas(solved, "open bigint, period bigint, start bigint, stop bigint")
    w = Window.partitionBy("open", "period").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    stitched = fragments.withColumn("new", F.when(F.col("start") <= reach - F.col("period"), 0).otherwise(1))
    stitched = stitched.withColumn("run", F.sum("new").over(w)).groupBy("open", "period", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    run = F.struct("start", (F.col("stop") - F.col("start")).alias("length"), "period")
    runs = stitched.where(f"stop - start >= {LEAST}").groupBy("open").agg(F.sort_array(F.collect_list(run)).alias("found"))
    # struct order is start, length, period; of one start no two runs have one length
    opened = kept.where("words IS NOT NULL").select("open", "doc_id", "words").join(runs, "open", "left")
    columns = [c.split()[0] for c in done.split(", ")]
    closed = kept.where("open IS NULL").select(*columns)
    return closed.unionByName(opened.select("doc_id", "words", "found").mapInPandas(finished, done))


def tail_repeated(doc_id: int | None, ws: list[bytes]) -> list[bytes]:
    """Of every tenth document by the CRC-32 of its decimal id, the words from some place on repeated with a period; others unchanged."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(ws)
    if h % 10 or not n:
        return ws
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return ws[:a] + (ws[a:a + p] * (-(-(n - a) // p)))[:n - a]
