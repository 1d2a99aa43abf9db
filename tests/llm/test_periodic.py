"""Periodic runs against a brute-force search, over the whole documents table and on odd rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from dustspark.llm import periodic, queries


def brute(w):
    """Maximal stretches by trying every period; a stretch whose smallest period is less is left out."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                block = w[i:j + q]
                if not any(block[d:] == block[:-d] for d in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(i + 1, j + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def by_tiles(w):
    held = {}
    found = {(q, at + a, at + b) for k, at, first, last, part in periodic.tiles(np.array(w, np.int32)) for q, a, b in periodic.solve(part, k, first, last)}
    for q, a, b in sorted(found):
        runs = held.setdefault(q, [])
        if runs and a <= runs[-1][1] - q:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return sorted(((a, b - a, q) for q, runs in held.items() for a, b in runs if b - a >= 12), key=lambda r: (r[0], r[2]))


def test_tiles_find_every_run():
    rnd = random.Random(8)
    total = 0
    for _ in range(500):
        n, letters = rnd.randrange(170), rnd.choice([1, 2, 2, 3, 5, 40])
        w = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(4) if n > 20 else 0):
            a, p = rnd.randrange(n), rnd.randrange(1, 45)
            for i in range(a + p, min(n, a + rnd.randrange(p, 150))):
                w[i] = w[i - p]
        want = brute(w)
        total += len(want)
        assert by_tiles(w) == want
    assert total > 400


def test_small_tiles_overlap_enough(monkeypatch):
    monkeypatch.setattr(periodic, "BOUNDARIES", 1)
    monkeypatch.setattr(periodic, "TILE_WORDS", 1)
    test_tiles_find_every_run()


def test_long_repetitions_take_no_quadratic_time():
    t0 = time.time()
    assert by_tiles([0] * 40_000) == [(0, 40_000, 1)]
    assert by_tiles([*range(9_000), *range(9_000), *range(4_000)]) == [(0, 22_000, 9_000)]
    assert time.time() - t0 < 30


def expected(doc_id, text):
    ws = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(ws)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    return ws


def row_of(doc_id, ws, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    text = " ".join(w for i, w in enumerate(ws) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("texts", [False, True])
def test_query_over_whole_documents(spark, small, texts):
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ws = expected(r["doc_id"], r["text"])
        number = {w: k for k, w in enumerate(dict.fromkeys(ws))}
        # numpy compares every shift of the whole text
        ids, runs = np.array([number[w] for w in ws], np.int32), []
        for q in range(1, len(ws) // 2 + 1):
            same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(np.int8), [0]])
            for a, b in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist(), strict=True):
                if b - a + q >= max(12, 2 * q) and not any(q % d == 0 and (ids[a + d:b + q] == ids[a:b + q - d]).all() for d in range(1, q)):
                    runs.append((a, b - a + q, q))
        want[r["doc_id"]] = row_of(r["doc_id"], ws, sorted(runs, key=lambda r: (r[0], r[2])))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = periodic.detect(docs, periodic.tail_repeated, texts=texts) if texts else queries.QUERIES["op12_periodic_runs"](spark, small)
    rows = got.collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows} == want
    assert sum(x[1] for x in want.values()) > 20
    if texts:
        for r in rows:
            assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]
            assert len(r["runs"]) == r["n_runs"]


def test_odd_rows(spark):
    line = "a b c d e f g "
    docs = spark.createDataFrame([(None, line * 3, 1), (None, line * 3, 2), (2, None, 3), (3, "", 4), (4, " \n\t", 5), (5, "x " * 11, 6), (5, "x " * 12, 7)],
                                 "doc_id int, text string, open int")
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.detect(docs).collect()))
    assert got == [(0, 21, [(0, 21, 7)], line.strip()), (0, 21, [(0, 21, 7)], line.strip()), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
                   (5, 11, [], ("x " * 11).strip()), (5, 12, [(0, 12, 1)], "x")]
