"""File formats, sinks and the refreshed index, on small files written by the tests."""

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.operators import daily as D
from dustspark.operators import profile as PR
from dustspark.operators import retrieval as B
from dustspark.plans import reports as RP
from dustspark.sources import columnar as CO
from dustspark.sources import dimensions as DM
from dustspark.sources import index as IX
from dustspark.sources import sinks as K
from dustspark.sources import text as TX


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_hourly_payload_files(spark, tmp_path):
    write(tmp_path / "w" / "a.json", json.dumps({"site_id": "s", "hourly": {
        "time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "temperature_2m": [1.0, None, 3.0], "wind_speed_10m": [5.0]}}, indent=1))
    write(tmp_path / "q" / "a.json", json.dumps({"site_id": "s", "hourly": {"time": ["2024-01-01T01:00"], "dust": [7.0], "pm10": [None]}}))
    weather = CO.read_payloads(spark, str(tmp_path / "w"), "hourly", list(CO.WEATHER_HOURLY))
    air = CO.read_payloads(spark, str(tmp_path / "q"), "hourly", list(CO.AIR_HOURLY))
    rows = CO.hourly_rows(weather, air).orderBy("ts").collect()
    assert [r["temp_c"] for r in rows] == [1.0, None, 3.0]
    assert [r["wind_ms"] for r in rows] == [5.0, None, None]
    assert [r["dust_ugm3"] for r in rows] == [None, 7.0, None]
    assert [r["aq_measured"] for r in rows] == [False, True, False]


def test_daily_payload_and_overlapping_pulls(spark, tmp_path):
    write(tmp_path / "a.json", json.dumps({"site_id": "s", "daily": {"time": ["2024-01-01", "2024-01-02"], "precipitation_sum": [0.5, 1.5]}}))
    rows = CO.daily_rows(CO.read_payloads(spark, str(tmp_path), "daily", list(CO.WEATHER_DAILY)))
    assert [r["precip_mm"] for r in rows.orderBy("date").collect()] == [0.5, 1.5]
    pulls = rows.withColumn("start", F.lit(1)).unionByName(
        rows.filter("precip_mm > 1").withColumns({"precip_mm": F.lit(9.0), "start": F.lit(2)}))
    assert [r["precip_mm"] for r in CO.latest_chunk_wins(pulls, ["site_id", "date"], "start").orderBy("date").collect()] == [0.5, 9.0]


def test_daily_csv_round_trip(spark, tmp_path):
    cols = ["site", "date", "pm10_max", "precip_mm"]
    path = write(tmp_path / "d.csv", "site,date,pm10_max,precip_mm\nb,2024-02-01,None,1\na,2024-01-31,12.5,\na,2024-01-30,nan,x\n")
    df = TX.read_daily_csv(spark, path, cols)
    rows = df.orderBy("site", "date").collect()
    assert [(r["site"], r["pm10_max"], r["precip_mm"], r["doy"]) for r in rows] == [("a", None, None, 30), ("a", 12.5, None, 31), ("b", None, 1.0, 32)]
    out = str(tmp_path / "out")
    K.write_csv(df.drop("doy"), out, ["site", "date"])
    back = TX.read_daily_csv(spark, out, cols)
    assert back.exceptAll(df).count() == 0 and back.count() == 3
    text = [open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv")]
    assert "a,2024-01-30,,\n" in "".join(text)


def test_corpus_facts_and_station_files(spark, tmp_path):
    good = json.dumps({"id": "1", "source": "x", "text": "  " + "t" * 90 + " ", "page": 4})
    path = write(tmp_path / "c.jsonl", good + "\n\n{broken\n" + json.dumps({"text": "short"}) + "\n")
    rows = TX.read_corpus(spark, path).collect()
    assert [(r["id"], r["text"], r["page"], r["kind"]) for r in rows] == [("1", "t" * 90, 4, "literature")]
    facts = {"facts": [{"id": "a", "claim": "c", "value": {"west": 15}, "verified": True}, {"id": "b", "text": "", "statement": "s", "verified": False}, {"id": "n"}]}
    df = TX.read_facts(spark, write(tmp_path / "k.json", json.dumps(facts, indent=1)))
    assert sorted(r["text"] for r in TX.usable_facts(df).collect()) == ["c", "s"]
    assert TX.fact_counts(df).first().asDict() == {"facts": 3, "verified": 1, "unverified": 2}
    assert df.filter("id = 'a'").first()["value"] == {"west": 15.0}
    st = TX.read_stations(spark, write(tmp_path / "s.txt", "head\nName,Lon\nA, 1.5,2,3\nB,x,2,3\nC,1,2\nD,4,5,6,more\n")).collect()
    assert [(r["name"], r["lon"], r["elev_m"]) for r in st] == [("A", 1.5, 3.0), ("D", 4.0, 6.0)]


def test_page_marked_texts(spark, tmp_path):
    write(tmp_path / "one.txt", "no marker")
    write(tmp_path / "two.txt", "cover\n<<<PAGE 3>>>\nalpha\n<<<PAGE 7>>>\nbeta")
    rows = TX.read_page_texts(spark, str(tmp_path)).collect()
    assert sorted((r["source"], r["page"], r["text"].strip()) for r in rows) == [("one", 1, "no marker"), ("two", 3, "alpha"), ("two", 7, "beta")]


def test_layer_catalogue_xml(spark, tmp_path):
    dim = "<Dimension><ows:Identifier>Time</ows:Identifier><Default>d</Default><Value>v1</Value><Value> </Value><Value>v2</Value></Dimension>"
    layer = "<Layer><ows:Title>T</ows:Title><ows:Identifier>{0}</ows:Identifier><Style><ows:Identifier>default</ows:Identifier></Style><Format>image/png</Format>{1}<TileMatrixSetLink><TileMatrixSet>L6</TileMatrixSet></TileMatrixSetLink></Layer>"
    xml = "<Capabilities xmlns='http://a' xmlns:ows='http://b'><Contents>" + layer.format(C.LAYERS_KEPT[0], dim) + \
        layer.format("Dust_Other", "") + layer.format("Sea_Ice", dim) + "</Contents></Capabilities>"
    layers = TX.read_layers(spark, write(tmp_path / "c.xml", xml))
    kept = TX.layer_rows(layers).collect()
    assert [r["layer"] for r in kept] == [C.LAYERS_KEPT[0]]
    assert kept[0]["dimensions"]["Time"].asDict() == {"default": "d", "n_values": 2, "first": "v1", "last": "v2"}
    assert kept[0]["tile_matrix_sets"] == ["L6"]
    assert TX.layer_rows(layers, keep=None).count() == 2


def test_probe_log_and_listing(spark, tmp_path):
    path = write(tmp_path / "p.tsv", "01\thttp://a\t200\t12\ttext/html\thttp://a\t1\t\n02\thttp://b\t000\t0\t\t\t0\ttimeout\n")
    assert [(r["id"], r["code"], r["bytes"], r["redirects"]) for r in TX.read_probe_log(spark, path).orderBy("id").collect()] == [("01", 200, 12, 1), ("02", 0, 0, 0)]
    df = spark.createDataFrame([("20240101/ 20240103/ 20240101/",), ("20240102/ 2024/ 20231231/",)], "value string")
    assert sorted(r["run"] for r in TX.latest_runs(df).collect()) == ["20240101", "20240102", "20240103"]


def test_aliases_merge_in_order(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, 2.0, 3.0)], "`pm2.5` double, PM25 double, other double")
    assert [tuple(r) for r in TX.canonical_names(df).collect()] == [(1.0, 3.0), (2.0, 3.0)]
    assert TX.canonical_names(df).columns == ["pm2_5_mean_ugm3", "other"]


def test_report_json_and_numbered_chunks(spark, tmp_path):
    days = spark.createDataFrame([(1, datetime.date(2024, 1, 1), 250.0, 5.0), (1, datetime.date(2024, 1, 2), None, 150.0)],
                                 "site_id long, date date, pm10_max double, dust_max double")
    K.write_report(RP.harvest_report(days, ["pm10_max", "dust_max"]), str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert (row["n_rows"], row["storm_pm10"], row["storm_pm10_or_dust"]) == (2, 1, 2)
    chunks = spark.createDataFrame([(2, 0, "b"), (1, 1, "a1"), (1, 0, "a0")], "doc_id long, pos int, text string")
    K.write_chunks(K.numbered_chunks(chunks, ["doc_id", "pos"]), str(tmp_path / "c"))
    back = spark.read.json(str(tmp_path / "c")).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in back] == [("chunk-00001", "a0"), ("chunk-00002", "a1"), ("chunk-00003", "b")]


def test_staging_replaces_only_its_sites(spark, tmp_path):
    path = str(tmp_path / "st")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "site_id int, v string")
    K.stage_site_pulls(rows, path)
    K.stage_site_pulls(spark.createDataFrame([(2, "c")], "site_id int, v string"), path)
    staged = spark.read.parquet(path)
    assert sorted((r["site_id"], r["v"]) for r in staged.collect()) == [(1, "a"), (2, "c")]
    wanted = spark.createDataFrame([(2,), (3,)], "site_id int")
    assert [r["site_id"] for r in K.sites_to_pull(wanted, staged).collect()] == [3]
    K.write_daily(spark.createDataFrame([(1, datetime.date(2024, 1, 2)), (1, datetime.date(2024, 1, 1))], "site_id int, date date"), str(tmp_path / "d"))
    assert [str(r["date"]) for r in spark.read.parquet(str(tmp_path / "d")).collect()] == ["2024-01-01", "2024-01-02"]


def test_index_refresh_touches_only_changed_files(spark, tmp_path):
    src, idx = tmp_path / "src", str(tmp_path / "idx")
    for i in range(6):
        write(src / f"{i}.txt", f"dust storm number{i}")
    docs = IX.source_texts(spark, str(src))
    assert IX.refresh(docs, idx) > 0
    assert IX.refresh(IX.source_texts(spark, str(src)), idx) == 0
    time.sleep(1.1)
    write(src / "2.txt", "rain only")
    os.unlink(src / "3.txt")
    now = IX.source_texts(spark, str(src))
    assert 1 <= IX.refresh(now, idx) <= 2
    index = IX.load_index(now, idx)
    fresh = B.build_index(now.select("doc_id", "text"))
    cols = ["doc_id", "dl", "term", "tf"]
    assert index.postings.select(*cols).exceptAll(fresh.postings.select(*cols)).count() == 0
    assert index.postings.count() == fresh.postings.count()


def test_site_dimension_is_complete(spark):
    sites = DM.site_dimension(spark)
    assert sites.count() == 12 and sites.select("id").distinct().count() == 12
    assert sites.join(DM.climate_dimension(spark), "climate").count() == 12
    assert sites.join(DM.region_targets(spark), "region").count() == 12


def test_priority_join_flags_its_source(spark):
    d = datetime.date
    spine = spark.createDataFrame([(1, d(2024, 1, i)) for i in (1, 2, 3)], "site_id int, date date")
    measured = spark.createDataFrame([(1, d(2024, 1, 1), None)], "site_id int, date date, pm10_mean double")
    modelled = spark.createDataFrame([(1, d(2024, 1, 1), 5.0), (1, d(2024, 1, 2), 6.0)], "site_id int, date date, pm10_mean double")
    rows = D.by_priority(spine, measured, modelled, ["pm10_mean"]).orderBy("date").collect()
    # a measured day keeps its (missing) measurement, it is not filled from the model
    assert [(r["aq_source"], r["pm10_mean"]) for r in rows] == [("measured_cams", None), ("modelled_climatology", 6.0), ("missing", None)]


def test_imputation_counts_out_of_range(spark):
    train = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (9.0, 30.0)], "a double, b double")
    bounds = PR.imputation_bounds(PR.feature_ranges(train, ["a", "b"]), ["a", "b"])
    rows = spark.createDataFrame([(None, 40.0), (float("nan"), 10.0)], "a double, b double")
    got = [tuple(r) for r in PR.impute_with_range_check(rows, ["a", "b"], bounds).collect()]
    assert got == [(2.0, 40.0, 0.5), (0.0, 10.0, 0.5)]


def test_conform_gives_one_representation_of_missing(spark):
    from dustspark import schema as SC
    raw = spark.createDataFrame([(7, "2024-01-31", "nan", "", "12.5"), (8, "bad", "inf", "None", "1")],
                                "site_id int, date string, tmax_c string, tmin_c string, pm10_max string")
    got = SC.conform(raw, SC.DAILY)
    assert got.columns == [f.split()[0] for f in SC.DAILY.split(", ")]
    rows = got.orderBy("site_id").collect()
    assert [(r["site_id"], r["tmax_c"], r["tmin_c"], r["pm10_max"], r["lat"]) for r in rows] == [("7", None, None, 12.5, None), ("8", None, None, 1.0, None)]
    assert rows[0]["date"] == datetime.date(2024, 1, 31) and rows[1]["date"] is None


def test_index_forgets_emptied_and_finds_returning_files(spark, tmp_path):
    from dustspark.operators import retrieval as R
    from dustspark.sources import index

    path = str(tmp_path / "index")

    def docs(*rows):
        return spark.createDataFrame([(i, t, f"f{i}", when) for i, t, when in rows], "doc_id long, text string, file string, modified string").withColumn(
            "modified", F.col("modified").cast("timestamp"))

    def found(words, *rows):
        loaded = index.load_index(docs(*rows), path)
        return {r["doc_id"] for r in R.search(loaded, spark.createDataFrame([(1, words)], "query_id long, query string")).collect()}

    first = (1, "amber basalt", "2024-01-01"), (2, "cobalt dune", "2024-01-01"), (3, "ember", "2024-01-01")
    index.refresh(docs(*first), path)
    assert found("amber cobalt", *first) == {1, 2}
    emptied = (1, "the and of", "2024-01-02"), *first[1:]
    index.refresh(docs(*emptied), path)
    assert found("amber", *emptied) == set()
    gone = spark.createDataFrame([], docs(*first).schema)
    index.refresh(gone, path)
    back = (2, "cobalt dune", "2024-01-05")
    index.refresh(docs(back), path)
    assert found("cobalt", back) == {2}


def test_order_breaks_are_counted(spark, tmp_path):
    from dustspark.sources import sinks as K
    rows = spark.range(0, 5000).selectExpr("id % 71 AS site_id", "id DIV 71 AS day")
    K.write_sorted(rows, str(tmp_path / "a"), ["site_id", "day"])
    assert tuple(K.order_breaks(spark, str(tmp_path / "a"), ["site_id", "day"]).first()) == (5000, 0)
    rows.where("day < 2").coalesce(1).write.parquet(str(tmp_path / "b"))
    assert tuple(K.order_breaks(spark, str(tmp_path / "b"), ["site_id", "day"]).first()) == (142, 1)
    assert tuple(K.order_breaks(spark, str(tmp_path / "b"), ["day", "site_id"]).first()) == (142, 0)


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(IX, "TASK_CHARS", 1000)
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(50)), "one", datetime.datetime(2025, 1, 1)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, modified timestamp")
    path = str(tmp_path / "idx")
    assert IX.refresh(docs, path) == 1
    sizes = [n for (n,) in spark.read.parquet(f"{path}/postings").groupBy(F.input_file_name()).count().select("count").collect()]
    assert sum(sizes) == 60 * 50 + 1 and max(sizes) < 1500  # and the row that stands for the file's bucket
    assert IX.load_index(docs, path).postings.count() == 60 * 50


def test_a_refresh_shuffles_texts_once_and_documents_as_one_row(spark, tmp_path, monkeypatch):
    plans, writer = [], type(spark.range(1).write)
    parquet = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **k: plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())) or parquet(self, path, *a, **k))
    rows = [(i % 50, f"amber dune x{i % 50} amber", f"f{i % 7}", datetime.datetime(2025, 1, 1)) for i in range(100)]  # each document in two files
    docs = spark.createDataFrame(rows, "doc_id long, text string, file string, modified timestamp")
    IX.refresh(docs, str(tmp_path / "idx"))
    plan = next(p for path, p in plans if path.endswith("/postings"))
    dealt = [line for line in plan.split("Initial Plan")[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 3 and not any("term" in line.split("]")[0].split("hashpartitioning")[1].split(")")[0] for line in dealt)
    got = spark.read.parquet(str(tmp_path / "idx/postings")).where("term IS NOT NULL")
    # a repeated document is counted as one, and stands once for each of its rows
    assert got.groupBy("doc_id", "dl", "term", "tf").count().select("doc_id", "dl", "term", "tf", "count").exceptAll(spark.createDataFrame(
        [(i, 4, t, n, 2) for i in range(50) for t, n in (("amber", 4), ("dune", 2), (f"x{i}", 2))], "doc_id long, dl int, term string, tf long, count long")).count() == 0
    assert got.count() == 50 * 3 * 2
