"""Streams against their batch forms."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from dustspark.plans.catalog import CATALOG
from dustspark.session import scratch
from dustspark.sources import fixtures as X
from dustspark.streaming import live as L

HOURS = "site_id long, ts timestamp, pm10 double, dust_ugm3 double, aod double, ghi_wm2 double, temp_c double"


def hour(site, day, h, v):
    return (site, datetime.datetime(2024, 1, day, h), float(v), None, None, 100.0, 20.0)


def run(spark, tmp_path, batches, build, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, HOURS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = L.watch_hours(spark, str(tmp_path / "in"), spark.createDataFrame([], HOURS).schema)
        L.run_available(build(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_late_hours_inside_the_watermark_count_and_a_restart_goes_on(spark, tmp_path):
    batches = [[hour(1, 1, 3, 10), hour(1, 2, 3, 30)], [hour(1, 1, 5, 20)], [hour(1, 9, 0, 0)], [hour(1, 1, 6, 999)], [hour(1, 20, 0, 0)]]
    out = run(spark, tmp_path, batches, L.daily_stream)
    got = {str(r["date"]): (r["hours"], r["pm10_ugm3"]) for r in out.collect()}
    assert got["2024-01-01"] == (2, 15.0)
    assert got["2024-01-02"] == (1, 30.0)
    assert out.filter("date = '2024-01-01'").count() == 1


def test_duplicate_delivery_counts_once(spark, tmp_path):
    batches = [[hour(1, 1, 3, 10), hour(1, 1, 3, 10)], [hour(1, 1, 3, 10), hour(1, 1, 4, 20)], [hour(1, 9, 0, 0)]]
    out = run(spark, tmp_path, batches, lambda s: L.daily_stream(L.unique_hours(s)))
    assert [(r["hours"], r["pm10_ugm3"]) for r in out.filter("date = '2024-01-01'").collect()] == [(2, 15.0)]


def test_late_hours_go_to_their_own_table(spark, tmp_path):
    """A lateness of a day: an hour whose day the watermark has passed is in no day and in the late table, once, also when a batch runs again."""
    batches = [[hour(1, 1, 3, 10), hour(1, 2, 3, 30)], [hour(1, 1, 5, 20), hour(1, 5, 1, 1)], [hour(1, 2, 6, 999), hour(1, 4, 0, 7)], [hour(1, 20, 0, 0)]]
    schema = spark.createDataFrame([], HOURS).schema
    folder = str(tmp_path)
    for rows in batches:
        spark.createDataFrame(rows, HOURS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        L.divert_late(L.watch_hours(spark, f"{folder}/in", schema), folder, f"{folder}/ckpt-split", "1 day", L.day_end(F.col("ts")))
    late = spark.read.parquet(f"{folder}/late").collect()
    assert [(r["ts"].day, r["pm10"], r["watermark"].day, r["batch"]) for r in late] == [(2, 999.0, 4, 2)]
    again = spark.createDataFrame(batches[2], HOURS)
    L.split_late(again, 2, folder, "1 day", L.day_end(F.col("ts")), again.columns)
    assert spark.read.parquet(f"{folder}/late").count() == 1 and spark.read.parquet(f"{folder}/ontime").count() == 6
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/ontime")
    L.run_available(L.daily_stream(stream), f"{folder}/out", f"{folder}/ckpt")
    got = {r["date"].day: (r["hours"], r["pm10_ugm3"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {1: (2, 15.0), 2: (1, 30.0), 4: (1, 7.0), 5: (1, 1.0)}


@pytest.mark.parametrize("name", ["r1_daily_stream", "r1_late_hours"])
def test_late_and_timely_hours_as_their_sql(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    cur = con.execute(CATALOG[name].sql)
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=str)
    got = sorted((tuple(r) for r in CATALOG[name].run(spark, small).select(*names).collect()), key=str)
    assert got == want and len(want) > 20


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, L.ROCKSDB)
    yield
    spark.conf.set(key, before)


STATE = "site_id long, ts timestamp, dust_factor double, precip_mm double, pm10_max double, threshold double"


def test_days_leave_in_order_whatever_their_arrival(spark, tmp_path, rocksdb):
    def day(site, d, dust, rain=0.0, pm10=10.0):
        return (site, datetime.datetime(2024, 1, d), dust, rain, pm10, 300.0)

    parts = [[day(1, 3, 1.0), day(2, 2, 1.0, pm10=400.0)], [day(1, 1, 2.0), day(1, 4, 1.0)], [day(1, 2, 2.0, rain=6.0), day(2, 1, 3.0), day(1, 2, 2.0, rain=6.0)], [day(1, 9, 0.5), day(2, 9, 0.0)], [day(1, 30, 0.0), day(2, 30, 0.0)]]
    for rows in parts:
        df = spark.createDataFrame(rows, STATE)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        L.run_available(L.site_state_stream(stream, "4 days"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = {(r["site_id"], r["date"].day): (round(r["exposure"], 6), r["days_since_rain"], r["storm_alert"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (2.0, 120, False), (1, 2): (0.6, 0, False), (1, 3): (1.6, 1, False), (1, 4): (2.6, 2, False), (1, 9): (3.1, 3, False),
                   (2, 1): (3.0, 120, False), (2, 2): (4.0, 120, True), (2, 9): (4.0, 120, False)}


def test_scratch_follows_the_cluster_setting():
    class Stub:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: "/shared/area/")

        class sparkContext:  # noqa: N801
            applicationId = "app"

    first, second = scratch(Stub), scratch(Stub)
    assert first.startswith("/shared/area/dustspark-app-") and first != second
