"""Closed syncmers against a plain version: anchors with their positions, likenesses over all of them, short and unlucky texts."""

import random
import string
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from dustspark.llm import queries, syncmers


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return signed(h)


def plain(text):
    """[(position, hash)] of a text."""
    ws = (text or "").encode().split()
    ws = [w.decode() for w in ws]
    if not ws:
        return []
    h = [chained([w]) for w in ws]
    pair = [chained([a, b]) for a, b in zip(h, h[1:], strict=False)]
    out = []
    for i in range(len(ws) - syncmers.K + 1):
        inner = pair[i:i + syncmers.K - 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, chained([pair[i], pair[i + 2], h[i + 4]])))
    return [(i, (v % (1 << 64)) >> 32) for i, v in (out or [(0, chained(ws))])]


def alike(x, y):
    x, y = {v for _, v in plain(x)}, {v for _, v in plain(y)}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_anchors_and_positions(spark):
    rnd = random.Random(4)
    texts = ["", None, " \n", "one", "a b c d", "a b c d e", "x " * 30] + [" ".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randrange(60))) for _ in range(80)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", syncmers.placed(F.col("t")).alias("p")).collect()
    assert {r["i"]: [tuple(x) for x in r["p"]] for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_unrelated_short_texts_are_not_alike(spark, tmp_path):
    rnd = random.Random(7)
    rows = [(i, " ".join("".join(rnd.choices(string.ascii_lowercase, k=6)) for _ in range(rnd.randrange(5, 8)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_syncmers(spark, str(tmp_path)).collect()
    assert len(got) == 300 and all(r["fingerprint"] for r in got)
    assert max(r["near_next"] for r in got) < 0.5 and max(r["near_edited"] for r in got) < 1


def test_whole_table_as_the_plain_version(spark, small):
    docs = sorted(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op7_syncmers(spark, small).collect()}
    assert len(got) == len(docs)
    for k, r in enumerate(docs):
        other = docs[(k + 1) % len(docs)]["text"] or ""
        text = r["text"] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        g = got[r["doc_id"]]
        assert g["near_edited"] == pytest.approx(alike(text, edited)) and g["near_next"] == pytest.approx(alike(text, other))
        want = sorted({v for _, v in plain(text)})[:syncmers.SIZE]
        assert g["fingerprint"] == "".join(f"{v:08x}" for v in want)
