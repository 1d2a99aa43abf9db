"""Windows and folds against plain loops over short random series."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators import features as FE
from dustspark.operators import mass_balance as MB
from dustspark.operators import policy as PL
from dustspark.operators import schedule as SC
from dustspark.operators import windows as W

DAILY = ("site_id long, date date, pm10_max double, pm10_mean double, dust_max double, dust_mean double, aod_mean double, "
         "gust_max_ms double, wind_max_ms double, precip_mm double, ghi_mj_m2 double, tmean_c double, rh_mean_pct double")


def series(sites=3, days=260, seed=1):
    rnd = random.Random(seed)
    rows = []
    for s in range(sites):
        d = datetime.date(2024, 1, 1)
        for _ in range(days):
            d += datetime.timedelta(days=rnd.choice([1, 1, 1, 2, 9]))
            rain = rnd.choice([0.0] * 30 + [0.4, 0.8, 1.0, 2.5, 5.0, 12.0]) if s else 0.0
            gap = rnd.random() < 0.05
            rows.append((s, d, None if gap else rnd.uniform(5, 1500), None if gap else rnd.uniform(5, 300), rnd.uniform(0, 600),
                         rnd.uniform(0, 300), rnd.uniform(0, 1.2), rnd.uniform(0, 25), rnd.uniform(0, 16),
                         None if rnd.random() < 0.05 else rain, rnd.uniform(0, 28), rnd.uniform(5, 45), rnd.uniform(5, 90)))
    return rows


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(series(), DAILY).repartition(4).persist()


def by_site(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["site_id"], r["date"])):
        out.setdefault(r["site_id"], []).append(r)
    return out


def rate(r):
    lift = 1 + min(2.2, max(0.0, r["gust_max_ms"] - 4) / 6)
    return 0.00042 * (0.42 * r["dust_max"] + 0.16 * (r["pm10_max"] or 0.0)) * lift / (1 + 2.6 * (r["precip_mm"] or 0.0))


def test_features_and_labels_match_loops(spark, daily):
    cut = "2024-09-01"
    got = by_site(FE.add_labels(FE.build_features(FE.with_threshold(daily, cut))).collect())
    raw = by_site(daily.collect())
    for site, rows in raw.items():
        early = sorted(r["pm10_max"] for r in rows if str(r["date"]) < cut and r["pm10_max"] is not None)
        thr = max(3 * early[len(early) // 2], 300.0)
        for i, r in enumerate(rows):
            g = got[site][i]
            assert g["threshold"] == pytest.approx(thr)
            since_rain = next((b for b in range(min(120, i + 1)) if (rows[i - b]["precip_mm"] or 0) >= 1.0), 120)
            since_storm = next((b for b in range(min(120, i + 1)) if (rows[i - b]["pm10_max"] or 0) >= thr), 120)
            assert (g["days_since_rain"], g["days_since_storm"]) == (since_rain, since_storm)
            mass = 0.0
            for b in range(min(120, i + 1)):
                if (rows[i - b]["precip_mm"] or 0) >= 1.0:
                    break
                mass += rate(rows[i - b])
            assert g["soiling"] == pytest.approx(98 * (1 - math.exp(-mass / 30)), abs=1e-9)
            last = [x["pm10_max"] for x in rows[max(0, i - 29):i + 1] if x["pm10_max"] is not None]
            assert g["pm10_max_30d"] == pytest.approx(max(last) if last else 0.0)


def test_thresholds_agree(spark, daily):
    a = {r["site_id"]: r["threshold"] for r in FE.storm_thresholds(daily, "2024-06-01").collect()}
    b = {r["site_id"]: r["threshold"] for r in FE.with_threshold(daily, "2024-06-01").collect()}
    assert a == b
    # a site without early rows takes all of its rows
    c = {r["site_id"]: r["threshold"] for r in FE.storm_thresholds(daily, "2000-01-01").collect()}
    assert set(c) == set(a)


def test_features_do_not_look_ahead(spark, daily):
    cut = datetime.date(2024, 10, 1)
    full = FE.build_features(FE.with_threshold(daily, "2024-06-01")).filter(F.col("date") <= cut)
    short = FE.build_features(FE.with_threshold(daily.filter(F.col("date") <= cut), "2024-06-01"))
    cols = ["site_id", "date", *C.FEATURES]
    assert full.select(*cols).exceptAll(short.select(*cols)).count() == 0
    assert full.count() == short.count()


def test_samples_trim_and_lead(spark, daily):
    raw = by_site(daily.collect())
    got = by_site(FE.make_samples(daily, "2024-06-01").collect())
    for site, rows in raw.items():
        assert [r["date"] for r in got[site]] == [r["date"] for r in rows[45:-3]]
        assert [r["pm10_t1"] for r in got[site]] == pytest.approx([r["pm10_max"] or 0.0 for r in rows[46:-2]])


def test_carry_forward_names_its_columns(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 7.0), (1, 2, None, None), (2, 3, None, 1.0)], "site_id int, ts int, a double, b double")
    got = {(r["site_id"], r["ts"]): (r["a"], r["b"]) for r in W.carry_forward(df, ["a"]).collect()}
    assert got == {(1, 1): (5.0, 7.0), (1, 2): (5.0, None), (2, 3): (None, 1.0)}


def median(values):
    v = sorted(values)
    n = len(v)
    return (v[(n - 1) // 2] + v[n // 2]) / 2


def balance_loop(rows, interval):
    fill = median([r["pm10_mean"] for r in rows if r["pm10_mean"] is not None])
    m, since, dry, out = 0.0, 10**6, 10**6, []
    for r in rows:
        p, w = r["precip_mm"] or 0.0, r["wind_max_ms"] * 3.6
        if p >= 5:
            m, dry = 0.0, 0
        elif p >= 0.5:
            m, dry = m * math.exp(-0.35 * p), 0
        else:
            dry += 1
        if w > 45:
            m *= max(0.0, 1 - 0.011 * (w - 45))
        ms = max(w, 0.5) / 3.6
        wind = 0.25 + 0.75 * math.exp(-0.5 * (math.log(ms / 5.5) / 0.85) ** 2)
        pm = fill if r["pm10_mean"] is None else r["pm10_mean"]
        m += 0.08 * wind * (max(pm, 5) / 100) ** 1.15
        if since >= interval:
            m, since, cleaned = m * 0.05, 0, 1
        else:
            since, cleaned = since + 1, 0
        out.append((m, cleaned, min(since, 999), min(dry, 999)))
    return out


@pytest.mark.parametrize("interval", [7, 3650])
def test_mass_balance_matches_a_loop(spark, daily, interval):
    prepared = MB.prepare(daily.withColumn("wind_kmh", F.col("wind_max_ms") * 3.6))
    factors = spark.createDataFrame([(s, 0.4 + s) for s in range(3)], "site_id long, site_factor double")
    masses = by_site(MB.mass_balance(prepared, factors, interval).collect())
    counts = by_site(MB.counters(prepared, interval).collect())
    for site, rows in by_site(daily.collect()).items():
        want = balance_loop(rows, interval)
        assert [r["mass"] for r in masses[site]] == pytest.approx([(0.4 + site) * w[0] for w in want], rel=1e-9)
        assert [(r["cleaned"], r["days_since_clean"], r["days_since_rain"]) for r in counts[site]] == [w[1:] for w in want]


def test_calibration_meets_its_target(spark, daily):
    prepared = MB.prepare(daily.withColumn("wind_kmh", F.col("wind_max_ms") * 3.6))
    sites = spark.createDataFrame([(0, "west"), (1, "east"), (2, "mars")], "site_id long, region string")
    got = {r["site_id"]: r for r in MB.calibrate(prepared, sites).collect()}
    for site, target in ((0, 15.0), (1, 45.0), (2, 25.0)):
        assert got[site]["target_loss_pct"] == target
        assert got[site]["achieved_loss_pct"] == pytest.approx(target, abs=0.05)


def schedule_loop(days, tau, lmax, threshold, interval):
    def loss(e):
        return 100 * min(0.55, lmax * (1 - math.exp(-max(0.0, e) / tau)))

    def steps(v, low, high):
        return 2 if v >= high else 1 if v >= low else 0
    out, exposure, severe = [], 0.0, False
    for i, (f, rain, risk) in enumerate(days):
        exposure = min(400.0, exposure + f)
        if rain >= 5:
            exposure *= 0.15
        pct = loss(exposure)
        act = (i + 1) % interval == 0 if interval else pct >= threshold or (severe and pct >= 0.6 * threshold)
        severe = risk + steps(pct, 12, 25) >= 5
        exposure = 0.0 if act else exposure
        out.append((pct, exposure, act, severe))
    return out


def test_schedules_match_a_loop(spark, daily):
    rollup = daily.select(
        "site_id", "date", (F.col("ghi_mj_m2") / 3.6).alias("irradiation_kwh_m2"), F.col("tmean_c").alias("tair_max_c"),
        F.lit(None).cast("double").alias("tcell_max_c"), F.lit(None).cast("double").alias("peak_ghi_wm2"), "rh_mean_pct",
        "wind_max_ms", "gust_max_ms", "precip_mm", F.col("pm10_mean").alias("pm10_ugm3"), F.col("dust_mean").alias("dust_ugm3"),
        F.col("aod_mean").alias("aod"))
    climates = {0: ("east", 0.92, 115.0), 1: ("west", 0.85, 0.85 / 0.003), 2: ("highland", 0.80, 0.80 / 0.0018)}
    plants = spark.createDataFrame([(s, climates[s][0], 5000.0, t) for s, t in ((0, 12.0), (1, 3.0), (2, 1.0))],
                                   "site_id long, climate string, capacity_kwp double, tuned_threshold_pct double")
    rows = SC.project(rollup, plants).collect()
    for site, (_, lmax, tau) in climates.items():
        for schedule, threshold, interval in (("fixed", None, 10), ("adaptive", {0: 12.0, 1: 3.0, 2: 1.0}[site], None)):
            mine = sorted((r for r in rows if r["site_id"] == site and r["schedule"] == schedule), key=lambda r: r["date"])
            want = schedule_loop([(r["dust_factor"], r["precip_mm"], r["risk"]) for r in mine], tau, lmax, threshold, interval)
            assert [r["loss_pct"] for r in mine] == pytest.approx([w[0] for w in want], abs=1e-9)
            assert [r["exposure"] for r in mine] == pytest.approx([w[1] for w in want], abs=1e-9)
            assert [r["cleaned"] for r in mine] == [w[2] for w in want]
            assert [r["dust_risk"] == "severe" for r in mine] == [w[3] for w in want]
            assert [r["i"] for r in mine] == list(range(len(mine)))


def test_policies_over_observed_days_match_a_loop(spark, daily):
    rollup = daily.select(
        "site_id", "date", (F.col("ghi_mj_m2") / 3.6).alias("irradiation_kwh_m2"), F.col("tmean_c").alias("tair_max_c"),
        F.lit(None).cast("double").alias("tcell_max_c"), F.lit(None).cast("double").alias("peak_ghi_wm2"), "rh_mean_pct",
        "wind_max_ms", "gust_max_ms", "precip_mm", F.col("pm10_mean").alias("pm10_ugm3"), F.col("dust_mean").alias("dust_ugm3"))
    sites = spark.createDataFrame([(0, "east"), (1, "west"), (2, None)], "site_id long, climate string")
    series = {r["site_id"]: r for r in PL.observed_series(rollup, sites).collect()}
    got = {(r["site_id"], r["ord"]): r for r in PL.observed_candidates(rollup, sites).collect()}
    assert len(series) == 3 and len(got) == 3 * 21
    arms = [(k, None) for k in C.INTERVAL_CANDIDATES] + [(None, t) for t in C.THRESHOLD_CANDIDATES] + [(None, None)]
    for site, row in series.items():
        assert [d["i"] for d in row["days"]] == list(range(len(row["days"])))
        for ord_, (interval, threshold) in enumerate(arms):
            e = lost = total = 0.0
            events, last = 0, -999
            for i, (_, f, kwh) in enumerate(row["days"]):
                e = min(400.0, e + f)
                pct = 100 * min(0.55, row["lmax"] * (1 - math.exp(-e / row["tau"])))
                total += pct
                lost += kwh * pct / 100
                clean = (i + 1) % interval == 0 if interval else threshold is not None and pct >= threshold and i - last >= 2
                if clean:
                    e, last, events = 0.0, i, events + 1
            r = got[site, ord_]
            assert r["events"] == events and r["n_days"] == len(row["days"])
            assert r["lost_kwh_per_kwp"] == pytest.approx(lost) and r["mean_loss_pct"] == pytest.approx(total / len(row["days"]))
