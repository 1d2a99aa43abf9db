"""Collocations against plain counting and against their SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from dustspark.llm import collocations, queries


def brute(rows, least, share, top):
    f = defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            ws = re.findall(r"[^ \t]+", piece)
            for n in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, count in f.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        cand = {k: v for k, v in count.items() if len(k) > 1 and v >= least}
        gone = {part for k, v in cand.items() if len(k) == 3 for part in (k[:2], k[1:]) if part in cand and 100 * v >= share * cand[part]}
        scored = []
        for k, a in cand.items():
            if k not in gone:
                s, _, left, right = min((1_000_000 * a * a // (count[k[:c]] * count[k[c:]]), c, count[k[:c]], count[k[c:]]) for c in range(1, len(k)))
                scored.append((-s, -a, " ".join(k).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("least", "top"), [(2, 7), (2, 100_000), (3, 40)])
def test_thresholds_settle_every_language(spark, least, top):
    rnd = random.Random(least * top)
    words = [f"{c}{d}" for c in "abcdeé🙂Z" for d in range(6)]
    rows = []
    for k in range(400):
        lang = rnd.choice(["en", "en", "en", "fr", None, "und", ""])
        ws = [rnd.choice(words) if rnd.random() < 0.6 else f"{lang} Tied {rnd.choice('xyz')} pair" for _ in range(rnd.randrange(40))]
        rows.append(("".join(w + rnd.choice([" ", " ", " ", "\t ", ". ", "\n"]) for w in ws) or None, lang))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = rows_of(collocations.mine(docs, least=least, top=top))
    assert got == brute(rows, least, collocations.SHARE, top)


def test_filters_that_let_all_through_change_nothing(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(" ".join(rnd.choice("abcdefg") for _ in range(60)), "en") for _ in range(60)]
    want = brute(rows, 4, 50, 30)
    full = spark.sparkContext.broadcast(np.full(collocations.BITS // 8, 255, np.uint8))
    monkeypatch.setattr(collocations, "_filter", lambda rows, *hashes: full)
    assert rows_of(collocations.mine(spark.createDataFrame(rows, "text string, lang string"), least=4, top=30)) == want


def test_products_beyond_64_bits(spark):
    a, left, right = 3_000_000_000_001, 4_000_000_000_003, 5_000_000_000_009
    got = spark.range(1).selectExpr(f"{a}L AS a", f"{left}L AS l", f"{right}L AS r").select(collocations._score("a", "l", "r").alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


def test_query_as_counting_and_sql(spark, small):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op13_collocations"](spark, small)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    got = rows_of(got)
    assert got == brute(rows, 10, 50, 2000)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(con.sql(queries.SQL["op13_collocations"]).fetchall()) == got
