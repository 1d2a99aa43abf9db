"""The catalog: contract of the entry module, and a sample of its queries against DuckDB."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from dustspark.plans.catalog import CATALOG

SAMPLE = [
    "cheapest_cleaning_interval", "a16_best_policy", "f3_schedule_projection", "f1_mass_balance", "f5_site_factor_calibration",
    "w1_rolling_features", "w5_training_samples", "w7_strict_rolling", "w10_carry_forward", "a1_rollup_null_as_zero", "a5_global_percentiles",
    "a20_feature_ranges", "j3_priority_join", "j9_nearest_site", "j12_newest_imagery", "b3_bm25_search", "q7_context_blocks", "s9_html_text",
    "s1_hourly_payload_scan", "x25_word_chunks", "m12_roc_auc", "m14_threshold_sweep", "q1_site_report", "k3_numbered_chunks",
]
if os.environ.get("ALL_QUERIES"):
    SAMPLE = [n for n, q in CATALOG.items() if q.sql]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def norm(v):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, small, name):
    df = CATALOG[name].run(spark, small)
    cur = duck.execute(CATALOG[name].sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, df.collect()) == table(cols, cur.fetchall())


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "site_id" and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_is_covered():
    covered = {i for q in CATALOG.values() for i in q.covers}
    wanted = ([f"A{i}" for i in range(1, 27)] + [f"W{i}" for i in range(1, 21)] + [f"F{i}" for i in range(1, 7)] + [f"J{i}" for i in range(1, 18)]
              + [f"P{i}" for i in range(1, 16)] + [f"X{i}" for i in range(1, 27)] + [f"S{i}" for i in range(1, 16)] + [f"T{i}" for i in range(1, 7)]
              + [f"U{i}" for i in range(1, 5)] + [f"B{i}" for i in range(1, 5)] + [f"M{i}" for i in range(1, 21)] + [f"R{i}" for i in range(1, 4)]
              + [f"Q{i}" for i in range(1, 12)] + ["K1", "K2", "K3", "K4", "K5", "K6", "B5"])
    assert [w for w in wanted if w not in covered] == []
