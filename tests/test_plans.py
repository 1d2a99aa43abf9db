"""How often plans repeat costly steps."""

import datetime

from pyspark.sql import functions as F

from dustspark.operators import policy as PL
from dustspark.plans import reports as RP

_DAY = ("site_id long, date date, pm10_ugm3 double, dust_ugm3 double, wind_max_ms double, gust_max_ms double, rh_mean_pct double, irradiation_kwh_m2 double, "
        "peak_ghi_wm2 double, tcell_max_c double, tair_max_c double, precip_mm double, aod double")


def _inputs(spark):
    sites = spark.createDataFrame([(1, "a", "inland", 100.0), (2, "b", None, 100.0)], "site_id long, name string, climate string, capacity_kwp double")
    rollup = spark.createDataFrame([(k, datetime.date(2024, 1, 1) + datetime.timedelta(i), 200.0 + i, None, 5.0, 6.0, 40.0, 6.0, None, None, 30.0, 0.0, 0.3)
                                    for k in (1, 2) for i in range(40)], _DAY)
    return rollup, sites


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_walked_once_and_not_by_an_interpreted_fold(spark):
    rollup, sites = _inputs(spark)
    plan = _plan(PL.annual_habits(PL.policy_costs(rollup, sites)))
    assert plan.count("MapInPandas") == 1 and "aggregate(" not in plan


def test_site_report_reads_what_its_parts_share(spark):
    rollup, sites = _inputs(spark)
    report = RP.site_report(rollup, sites)
    plan = _plan(report)
    assert "MapInPandas" not in plan and "aggregate(" not in plan
    assert report.select("site_id", F.col("decision").isNotNull().alias("decided")).orderBy("site_id").collect() == [(1, True), (2, True)]


def test_a_batch_of_due_days_leaves_the_list_at_once():
    from types import SimpleNamespace

    import pandas as pd

    from dustspark.streaming.live import SiteState

    class Cell:
        def __init__(self):
            self.value, self.reads = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.reads += 1
            return self.value if self.value is not None else []

        def put(self, value):
            self.value = value

        update = put

        def clear(self):
            self.value = None

    state, waiting, timers = Cell(), Cell(), set()
    handle = SimpleNamespace(getValueState=lambda *a: state, getListState=lambda *a: waiting, registerTimer=timers.add)
    site = SiteState()
    site.init(handle)
    days = pd.to_datetime([f"2024-01-{d:02d}" for d in (5, 2, 9, 3, 1)])
    rows = pd.DataFrame({"ts": days, "dust_factor": [5.0, 2.0, 9.0, 3.0, 1.0], "precip_mm": 0.0, "pm10_max": 1.0, "threshold": 2.0})
    list(site.handleInputRows((7,), iter([rows]), None))
    at = {d: int(pd.Timestamp(f"2024-01-{d:02d}", tz="UTC").timestamp() * 1000) for d in (1, 5, 9)}
    assert timers == {at[1]}  # one timer, that of the earliest day
    before = waiting.reads
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: at[5] + 1)
    out = pd.concat(site.handleExpiredTimer((7,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: at[1])))
    assert out["exposure"].tolist() == [1.0, 3.0, 6.0, 11.0] and waiting.reads == before + 1
    assert timers == {at[1], at[9]} and [w[0] for w in waiting.value] == [at[9]]


def test_shared_days_are_rolled_up_once(spark, small):
    from dustspark.plans.catalog import CATALOG

    for name in ("a21_bin_counts", "m0_training_table"):
        files = CATALOG[name].run(spark, small).inputFiles()
        assert files and not any("lineitem" in f for f in files), name
