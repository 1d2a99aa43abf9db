"""Exact ranks, nearest neighbours, search and as-of joins against brute force, hot keys included."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators import asof
from dustspark.operators import conversation as CV
from dustspark.operators import evaluation as EV
from dustspark.operators import nearest as N
from dustspark.operators import ranks as R
from dustspark.operators import retrieval as B


@pytest.fixture(scope="module")
def hot_values():
    rnd = random.Random(3)
    # a third of all rows hold one value
    return [rnd.gauss(100, 30) for _ in range(2000)] + [100.0] * 1000


def test_nearest_rank(spark, hot_values):
    df = spark.createDataFrame([(v,) for v in hot_values + [None]], "v double").repartition(5)
    got = {r["percent"]: r["value"] for r in R.nearest_rank(df, "v", [0, 10, 50, 99.9, 100]).collect()}
    s = sorted(hot_values)
    assert got == {p: s[min(int(len(s) * p / 100), len(s) - 1)] for p in (0, 10, 50, 99.9, 100)}


def test_interpolated_quantiles_by_group(spark, hot_values):
    rows = [("a", v) for v in hot_values] + [("b", float(i)) for i in range(7)] + [("c", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["prob"]): r["value"] for r in R.interpolated_quantiles(df, "v", [0.0, 0.33, 0.5, 1.0], by="k").collect()}
    for k in "abc":
        v = np.array([x for kk, x in rows if kk == k])
        for p in (0.0, 0.33, 0.5, 1.0):
            assert got[k, p] == pytest.approx(np.quantile(v, p), rel=1e-12)


def test_running_number_is_global_and_exact(spark):
    rnd = random.Random(5)
    # one document holds a third of the chunks
    rows = [(rnd.randrange(200), i) for i in range(1000)] + [(77, 1000 + i) for i in range(500)]
    df = spark.createDataFrame(rows, "d long, p long").repartition(6)
    got = R.running_number(df, ["d", "p"], F.col("d") + F.col("p") / 1e7).collect()
    assert {(r["d"], r["p"]): r["rn"] for r in got} == {k: i + 1 for i, k in enumerate(sorted(rows))}


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.fixture(scope="module")
def places():
    rnd = random.Random(11)
    cat = [(i, 16 + rnd.random() * 16, 34 + rnd.random() * 22) for i in range(120)]
    # a dense cluster, and many entries at one position
    cat += [(200 + i, 24.7 + rnd.random() / 50, 46.6 + rnd.random() / 50) for i in range(200)]
    cat += [(500 + i, 21.5, 39.2) for i in range(80)] + [(700, -33.0, -70.0)]
    pts = [(i, 15 + rnd.random() * 18, 33 + rnd.random() * 24) for i in range(150)] + [(900, 21.5, 39.2), (901, 80.0, 10.0)]
    return cat, pts


@pytest.mark.parametrize("k,within,digits", [(1, 400.0, None), (3, 1500.0, 1), (8, 60.0, 1), (1, None, None)])
def test_k_nearest_matches_brute_force(spark, places, k, within, digits):
    cat, pts = places
    found = N.k_nearest(spark.createDataFrame(pts, "id long, lat double, lon double"),
                        spark.createDataFrame(cat, "ord long, lat double, lon double"), k, within, digits=digits)
    got = {}
    for r in found.filter(F.col("entry").isNotNull()).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["entry"]["ord"])
    want = {}
    for i, lat, lon in pts:
        d = [(km((lat, lon), (c[1], c[2])), c[0]) for c in cat]
        d = [(round(x, digits) if digits is not None else x, o) for x, o in d if within is None or x <= within]
        if d:
            want[i] = [o for _, o in sorted(d)[:k]]
    assert got == want


def test_nearest_by_squared_degrees(spark, places):
    cat, pts = places
    found = N.k_nearest(spark.createDataFrame(pts, "id long, lat double, lon double"),
                        spark.createDataFrame(cat, "ord long, lat double, lon double"), metric="deg2").collect()
    want = {i: min(cat, key=lambda c: ((c[1] - a) ** 2 + (c[2] - o) ** 2, c[0]))[0] for i, a, o in pts}
    assert {r["id"]: r["entry"]["ord"] for r in found} == want


def test_site_names_resolve_to_the_first_site(spark):
    cat = spark.createDataFrame([(i, s[0], s[1]) for i, s in enumerate(C.SITES)], "ord int, site_id string, name string")
    asked = spark.createDataFrame([("Sakaka",), ("al ",), ("PV",), ("neom",), ("a",), ("xyz",), ("",)], "query string")
    got = {r["query"]: r["site"] and r["site"]["site_id"] for r in N.resolve_names(asked, cat).collect()}
    assert got["Sakaka"] == "sakaka" and got["PV"] == "sakaka" and got["neom"] == "neom" and got["a"] == "sakaka"
    assert got["al "] == "riyadh" and got["xyz"] is None and got[""] is None


def test_newest_available_tolerance(spark):
    day = datetime.date
    avail = spark.createDataFrame([("m", day(2023, 5, 1)), ("m", day(2024, 2, 15)), ("d", day(2024, 3, 1)), ("d", day(2024, 3, 5))],
                                  "layer string, date date")
    req = spark.createDataFrame([("d", "daily", day(2024, 3, 21)), ("d", "daily", day(2024, 3, 26)), ("d", "daily", day(2024, 3, 4)),
                                 ("d", "daily", day(2024, 2, 1)), ("m", "monthly", day(2025, 5, 31)), ("m", "monthly", day(2025, 6, 1))],
                                "layer string, kind string, date date")
    got = {(r["layer"], r["date"]): r["effective_date"] for r in asof.newest_available(req, avail).collect()}
    assert got == {("d", day(2024, 3, 21)): day(2024, 3, 5), ("d", day(2024, 3, 26)): None, ("d", day(2024, 3, 4)): day(2024, 3, 1),
                   ("d", day(2024, 2, 1)): None, ("m", day(2025, 5, 31)): day(2023, 5, 1), ("m", day(2025, 6, 1)): None}


def test_fetch_windows_clip_the_last_one(spark):
    df = spark.createDataFrame([(datetime.date(2024, 1, 1), datetime.date(2024, 1, 25))], "start date, end date")
    got = [(str(r["window_start"]), str(r["window_end"])) for r in asof.fetch_windows(df, 10).orderBy("window_start").collect()]
    assert got == [("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"), ("2024-01-21", "2024-01-25")]


def brute_bm25(docs, query, k):
    toks = {i: t.split() for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    q = query.split()
    out = []
    for i, t in toks.items():
        s = 0.0
        for w in sorted(set(q)):
            f = t.count(w)
            if f:
                idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                s += (1 + 0.5 * q.count(w) / len(q)) * idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s > 0:
            out.append((-round(s, 9), i))
    return [i for _, i in sorted(out)[:k]]


@pytest.mark.parametrize("limit", [10**6, 0])
def test_bm25_matches_brute_force_with_and_without_salting(spark, monkeypatch, limit):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    # a term in every document, and a third of the documents are copies of one text
    docs = [(i, "dust " + " ".join(rnd.choices(words, k=rnd.randint(1, 40)))) for i in range(100)]
    docs += [(100 + i, docs[0][1]) for i in range(50)] + [(150, "")]
    asked = [(1, "dust w1 w1 w2"), (2, "w3"), (3, "absent"), (4, "w5 w6 w7 dust")]
    monkeypatch.setattr(B, "is_small", lambda df: limit > 0)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    for hits in (B.search_documents(d, q, 6), B.search(B.build_index(d), q, 6)):
        got = {}
        for r in hits.orderBy("query_id", "pos").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {i: brute_bm25(docs, t, 6) for i, t in asked if brute_bm25(docs, t, 6)}


def test_context_budget_cuts_the_last_text(spark):
    hits = spark.createDataFrame([(1, 1, "a", 3, "x" * 60), (1, 2, "b", None, "y" * 60), (1, 3, "c", 0, "z")],
                                 "query_id int, pos int, source string, page int, text string")
    row = B.context_blocks(hits, 100).first()
    assert row["citations"] == 2
    assert row["context"] == "[1] a (p.3):\n" + "x" * 60 + "\n\n[2] b:\n" + "y" * 40


def test_recent_turns_filter_after_the_cut(spark):
    rows = [(1, t, "system" if t == 7 else "user", "" if t == 6 else "x" * 5000) for t in range(9)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    got = CV.recent_turns(df).collect()
    assert sorted(r["turn"] for r in got) == [3, 4, 5, 8]
    assert {len(r["content"]) for r in got} == {4000}


def test_auc_and_tied_ranks(spark):
    rnd = random.Random(4)
    rows = [(int(rnd.random() < 0.3), round(rnd.random(), 2)) for _ in range(400)] + [(i % 2, 0.5) for i in range(200)]
    got = EV.roc_auc(spark.createDataFrame(rows, "y int, p double")).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got["auc"] == pytest.approx(want)
    none = EV.roc_auc(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")).first()
    assert none["auc"] is None


def test_threshold_sweep_and_choice(spark):
    rnd = random.Random(9)
    rows = [(int(rnd.random() < p), p) for p in (round(rnd.random(), 3) for _ in range(600))] + [(1, 0.9)] * 200
    df = spark.createDataFrame(rows, "y int, p double")
    grid = np.unique(np.quantile([p for _, p in rows], np.linspace(0.5, 0.999, 60)))
    table = EV.threshold_sweep(df).orderBy("threshold").collect()
    assert [r["threshold"] for r in table] == pytest.approx(list(grid))
    best = (0.5, -1.0, -1.0)
    for r in table:
        tp = sum(1 for y, p in rows if y == 1 and p >= r["threshold"])
        fp = sum(1 for y, p in rows if y == 0 and p >= r["threshold"])
        fn = sum(1 for y, _ in rows if y == 1) - tp
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        f1 = round(2 * tp / (2 * tp + fp + fn), 3)
        if (f1, round(100 * tp / (tp + fn), 2)) > best[1:]:
            best = (r["threshold"], f1, round(100 * tp / (tp + fn), 2))
    assert EV.choose_threshold(df).first()["threshold"] == pytest.approx(best[0])
    assert EV.choose_threshold(df.withColumn("y", F.lit(0))).first()["threshold"] == 0.5


def test_regression_report_leaves_tiny_targets_out_of_mape(spark):
    rows = [(0.0, 1.0)] * 3 + [(float(i), i + 0.5) for i in range(5, 15)]
    r = EV.regression_report(spark.createDataFrame(rows, "y double, p double")).first()
    y, p = np.array(rows).T
    keep = np.abs(y) >= 0.1 * np.abs(y).mean()
    assert r["mape_pct"] == pytest.approx(100 * np.mean(np.abs(p - y)[keep] / np.abs(y[keep])))
    assert r["r2"] == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2))
    few = EV.regression_report(spark.createDataFrame(rows[:4], "y double, p double")).first()
    assert few["mape_pct"] is None


def test_blend_weights(spark):
    df = spark.createDataFrame([(1.0, 1.1, 1.3)] * 50, "y double, a double, b double")
    r = EV.blend_weights(df, "a", "b").first()
    assert r["weight_a"] == pytest.approx(0.75) and r["weight_b"] == pytest.approx(0.25)
    few = EV.blend_weights(df.limit(10), "a", "b").first()
    assert (few["weight_a"], few["weight_b"]) == (0.5, 0.5)


def test_sites_without_a_known_climate_count_as_inland(spark):
    from dustspark.operators import policy as PL

    sites = spark.createDataFrame([(1, "inland", 100.0), (2, None, 100.0), (3, "moon", 100.0)],
                                  "site_id long, climate string, capacity_kwp double")
    got = PL.with_climate(sites).select("site_id", "climate", "lmax", "tau").collect()
    assert {r["site_id"] for r in got} == {1, 2, 3}
    assert len({tuple(r)[1:] for r in got}) == 1
    day = "date date, pm10_ugm3 double, dust_ugm3 double, wind_max_ms double, gust_max_ms double, rh_mean_pct double, irradiation_kwh_m2 double, "
    rollup = spark.createDataFrame([(k, datetime.date(2024, 1, 1 + i), 200.0, None, 5.0, 6.0, 40.0, 6.0, None, None, 30.0) for k in (1, 2, 3) for i in range(30)],
                                   "site_id long, " + day + "peak_ghi_wm2 double, tcell_max_c double, tair_max_c double")
    best = PL.best_policy(PL.policy_costs(rollup, sites)).select("site_id", "best.net_cost_sar").collect()
    assert len(best) == 3 and len({r["net_cost_sar"] for r in best}) == 1
