"""Readers, checked on payloads which Spark derives from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions.cleaning import num
from dustspark.operators import asof
from dustspark.operators.nearest import k_nearest
from dustspark.operators.profile import complete_rows, key_profile
from dustspark.operators.retrieval import chunk_pages
from dustspark.operators.features import storm_thresholds
from dustspark.plans.catalog.base import pick, query, rounded, sql, values
from dustspark.session import scratch
from dustspark.sources import columnar as CO
from dustspark.sources import fixtures as X
from dustspark.sources import sinks as K
from dustspark.sources import text as TX
from dustspark.sources.dimensions import site_dimension

_HOUR = "yyyy-MM-dd'T'HH:mm"


def _arrays(rows: DataFrame, order: str, names: dict[str, Column], time: Column) -> list[Column]:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order), time.alias("time"), *[c.alias(n) for n, c in names.items()])))
    return [ordered.alias("_r")]


def _payloads(rows: DataFrame, order: str, block: str, names: dict[str, Column], time: Column, short: bool = False) -> DataFrame:
    """Struct-of-arrays JSON text per site and month, parsed back under the declared schema.

    ``short`` cuts the last entry of every array but ``time``.
    """
    packed = rows.groupBy("site_id", F.trunc(order, "month").alias("_m")).agg(*_arrays(rows, order, names, time))
    cut = F.size("_r") - (1 if short else 0)
    body = F.struct(F.col("_r.time").alias("time"), *[F.slice(F.col(f"_r.{n}"), F.lit(1), cut).alias(n) for n in names])
    text = packed.select("site_id", F.to_json(F.struct(body.alias(block)), {"ignoreNullFields": "false"}).alias("json"))
    schema = CO.payload_schema(block, list(names), "_k string")
    return text.select("site_id", F.from_json("json", schema).alias("_j")).select("site_id", F.col(f"_j.{block}").alias(block))


@query("s1_hourly_payload_scan", "S1", sql("hourly", """SELECT site_id, strftime(ts, '%Y-%m-%d %H:00') AS hour,
      round(ghi_wm2,4) AS ghi_wm2, round(temp_c,4) AS temp_c, round(CASE WHEN last THEN NULL ELSE pm10 END,4) AS pm10,
      round(CASE WHEN last THEN NULL ELSE dust_ugm3 END,4) AS dust_ugm3, round(CASE WHEN last THEN NULL ELSE aod END,4) AS aod,
      (CASE WHEN last THEN NULL ELSE dust_ugm3 END) IS NOT NULL AS aq_measured
    FROM (SELECT *, row_number() OVER (PARTITION BY site_id, date_trunc('month', ts) ORDER BY ts DESC) = 1 AS last FROM hourly)"""))
def hourly_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = X.hourly(spark, d)
    time = F.date_format("ts", _HOUR)
    weather = _payloads(rows, "ts", "hourly", {"shortwave_radiation": F.col("ghi_wm2"), "temperature_2m": F.col("temp_c")}, time)
    air = _payloads(rows, "ts", "hourly", {"pm10": F.col("pm10"), "dust": F.col("dust_ugm3"),
                                           "aerosol_optical_depth": F.col("aod")}, time, short=True)
    out = CO.hourly_rows(weather, air)
    return pick(out, "site_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("hour"), "ghi_wm2", "temp_c",
                "pm10", "dust_ugm3", "aod", "aq_measured")


@query("s2_daily_payload_scan", "S2", sql("daily", """SELECT site_id, date, round(ghi_mj_m2,4) AS ghi_mj_m2, round(tmean_c,4) AS tmean_c,
      round(gust_max_ms,4) AS gust_max_ms, round(precip_mm,4) AS precip_mm, CAST(NULL AS DOUBLE) AS tmax_c FROM daily"""))
def daily_scan(spark: SparkSession, d: str) -> DataFrame:
    names = {"shortwave_radiation_sum": F.col("ghi_mj_m2"), "temperature_2m_mean": F.col("tmean_c"),
             "wind_gusts_10m_max": F.col("gust_max_ms"), "precipitation_sum": F.col("precip_mm")}
    out = CO.daily_rows(_payloads(X.daily(spark, d), "date", "daily", names, F.date_format("date", "yyyy-MM-dd")))
    return pick(out, "site_id", "date", "ghi_mj_m2", "tmean_c", "gust_max_ms", "precip_mm", "tmax_c")


@query("s3_chunk_union", "S3 U1", sql("daily", """SELECT site_id, date, round(pm10_mean,4) AS pm10_mean,
      CASE WHEN date < DATE '1998-01-01' THEN NULL ELSE round(dust_mean,4) END AS dust_mean FROM daily"""))
def chunk_union(spark: SparkSession, d: str) -> DataFrame:
    days = X.daily(spark, d).select("site_id", "date", "pm10_mean", "dust_mean")
    cut = F.lit("1998-01-01").cast("date")
    return rounded(CO.merge_chunks(days.filter(F.col("date") < cut).drop("dust_mean"), days.filter(F.col("date") >= cut)))


@query("s3_latest_chunk_wins", "S3 R2", sql("daily", """SELECT site_id, date, round(pm10_mean + (CASE WHEN dayofmonth(date) <= 10 AND date >= DATE '1995-03-01' THEN 1 ELSE 0 END),4) AS pm10_mean FROM daily"""))
def latest_chunk(spark: SparkSession, d: str) -> DataFrame:
    days = X.daily(spark, d).select("site_id", "date", "pm10_mean")
    first = days.withColumn("chunk_start", F.trunc("date", "year"))
    again = days.filter((F.dayofmonth("date") <= 10) & (F.col("date") >= F.lit("1995-03-01").cast("date"))).select(
        "site_id", "date", (F.col("pm10_mean") + 1).alias("pm10_mean"), F.date_add(F.trunc("date", "year"), 1).alias("chunk_start"))
    return rounded(CO.latest_chunk_wins(first.unionByName(again), ["site_id", "date"], "chunk_start").drop("chunk_start"))


@query("s4_fetch_windows", "S4", sql("daily", """SELECT site_id, CAST(w AS DATE) AS window_start, CAST(least(CAST(w AS DATE) + 89, b) AS DATE) AS window_end
    FROM (SELECT site_id, a, b, unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 90 DAY)) AS w FROM (SELECT site_id, min(date) AS a, max(date) AS b FROM daily GROUP BY 1))"""))
def fetch_windows(spark: SparkSession, d: str) -> DataFrame:
    spans = X.daily(spark, d).groupBy("site_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    return asof.fetch_windows(spans, 90).select("site_id", "window_start", "window_end")


_DIRTY = """CASE l_linenumber % 6 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN 'nan' WHEN 3 THEN 'inf' ELSE CAST(l_quantity AS VARCHAR) END"""


def dirty_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") % 6
    raw = (F.when(n == 0, "").when(n == 1, "None").when(n == 2, "nan").when(n == 3, "inf")
           .otherwise(F.col("l_quantity").cast("string")))
    return X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", raw.alias("raw"))


@query("s5_typed_scan", "S5", f"""SELECT year(l_shipdate) AS year, dayofyear(l_shipdate) AS doy, count(*) AS n,
      count(v) AS n_valid, round(sum(v),4) AS total FROM (SELECT *, CASE WHEN isfinite(TRY_CAST({_DIRTY} AS DOUBLE)) THEN TRY_CAST({_DIRTY} AS DOUBLE) END AS v FROM lineitem) GROUP BY 1, 2""")
def typed_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = dirty_lines(spark, d).select(F.to_date("l_shipdate").alias("date"), num("raw").alias("v"))
    return rounded(rows.groupBy(F.year("date").cast("long").alias("year"), F.dayofyear("date").cast("long").alias("doy")).agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_valid"), F.sum("v").alias("total")))


@query("s6_json_corpus_scan", "S6", """SELECT CAST(doc_id AS VARCHAR) AS id, source, length(text) AS chars FROM (
      SELECT doc_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents) WHERE doc_id % 10 NOT IN (3, 7) AND length(text) > 80""")
def json_corpus(spark: SparkSession, d: str) -> DataFrame:
    docs = X.documents(spark, d)
    line = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "source", "text"))
    lines = docs.select(F.when(F.col("doc_id") % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 2))
                        .when(F.col("doc_id") % 10 == 7, " ").otherwise(line).alias("value"))
    return TX.usable_chunks(TX.parse_json_lines(lines, TX.CHUNK_SCHEMA)).select(
        "id", "source", F.length("text").cast("long").alias("chars"))


@query("s7_fact_texts", "S7", """SELECT source, 'fact' AS kind, count(*) AS facts, CAST(sum(length(t)) AS BIGINT) AS chars FROM (
      SELECT source, CASE doc_id % 4 WHEN 0 THEN nullif(text,'') WHEN 1 THEN lang WHEN 2 THEN source END AS t FROM documents) WHERE t IS NOT NULL GROUP BY 1""")
def fact_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    none = F.lit(None).cast("string")
    facts = X.documents(spark, d).select(
        F.when(k == 0, F.col("text")).otherwise("").alias("statement"), F.when(k == 1, F.col("lang")).alias("fact"),
        F.when(k == 2, "").alias("text"), F.when(k == 2, F.col("source")).alias("claim"), "source", none.alias("url"))
    return TX.usable_facts(facts).groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("facts"), F.sum(F.length("text")).alias("chars"))


def marked_documents(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    marked = F.concat(F.lit("cover\n<<<PAGE 4>>>\n"), F.substring(F.col("text"), F.lit(1), half),
                      F.lit("\n<<<PAGE 5>>>\n"), F.substring(F.col("text"), half + 1, F.length("text")))
    return X.documents(spark, d).select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(marked).alias("text"))


@query("s8_page_split", "S8", """SELECT doc_id, CAST(page AS INTEGER) AS page, length(body) AS chars, md5(body) AS digest FROM (
      SELECT doc_id, 1 AS page, text AS body FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 4, chr(10) || substr(text, 1, length(text) // 2) || chr(10) FROM documents WHERE doc_id % 3 <> 0
      UNION ALL SELECT doc_id, 5, chr(10) || substr(text, length(text) // 2 + 1) FROM documents WHERE doc_id % 3 <> 0)""")
def page_split(spark: SparkSession, d: str) -> DataFrame:
    return TX.split_pages(marked_documents(spark, d)).select(
        "doc_id", "page", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("s11_station_lines", "S11", """SELECT c_name AS name, round(34.0::DOUBLE + (c_custkey*53 % 220)/10.0::DOUBLE,4) AS lon,
      round(16.0::DOUBLE + (c_custkey*37 % 165)/10.0::DOUBLE,4) AS lat, round(c_acctbal,2) AS elev_m FROM customer WHERE c_custkey % 7 NOT IN (2, 5)""")
def station_lines(spark: SparkSession, d: str) -> DataFrame:
    s = X.stations(spark, d)
    k = F.col("station_id") % 7
    line = F.concat_ws(",", F.concat(F.lit(" "), F.col("name")), F.col("lon").cast("string"),
                       F.when(k == 2, "n/a").otherwise(F.col("lat").cast("string")), F.col("elev_m").cast("string"))
    lines = s.select(F.when(k == 5, F.concat_ws(",", "name", F.lit("1"), F.lit("2"))).otherwise(line).alias("value"))
    return pick(TX.parse_stations(lines), "name", "lon", "lat", F.round("elev_m", 2).alias("elev_m"))


@query("s12_layer_catalogue", "S12 P12", """SELECT 'AIRS_L2_Dust_Score_' || event_type || '_' || user_id AS layer, 'Title ' || event_type AS title, min(CAST(ts AS DATE))::VARCHAR AS first_value,
      max(CAST(ts AS DATE))::VARCHAR AS last_value, CAST(count(DISTINCT CAST(ts AS DATE)) AS INTEGER) AS n_values, 'd' || user_id AS default_value FROM events
    WHERE event_type <> 'error' GROUP BY event_type, user_id""")
def layer_catalogue(spark: SparkSession, d: str) -> DataFrame:
    ev = X.table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").cast("string").alias("day")).distinct()
    name = F.when(F.col("event_type") == "error", F.lit("Sea_Ice_")).otherwise(F.lit("AIRS_L2_Dust_Score_"))
    doc = ev.groupBy("event_type", "user_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("day")), lambda v: F.concat(F.lit("<Value>"), v, F.lit("</Value>"))), "").alias("v")).select(
        F.concat(F.lit("<Layer><Identifier> "), name, "event_type", F.lit("_"), F.col("user_id").cast("string"),
                 F.lit(" </Identifier><Title>Title "), "event_type", F.lit("</Title><Format>image/png</Format>"
                 "<Style><Identifier>default</Identifier></Style><Dimension><Identifier>Time</Identifier><Default>d"),
                 F.col("user_id").cast("string"), F.lit("</Default>"), "v", F.lit("</Dimension></Layer>")).alias("xml"))
    layers = doc.select(F.from_xml("xml", TX.LAYER_SCHEMA).alias("l")).select("l.*")
    time = F.col("dimensions")["Time"]
    return TX.layer_rows(layers, keep=None).select(
        "layer", "title", time["first"].alias("first_value"), time["last"].alias("last_value"),
        time["n_values"].alias("n_values"), time["default"].alias("default_value"))


@query("s13_probe_lines", "S13", """SELECT CAST(event_id AS VARCHAR) AS id, 'u/' || user_id AS url, CAST(200 + event_id % 5 AS INTEGER) AS code,
      CAST(floor(value) AS BIGINT) AS bytes, event_type AS content_type, CAST(event_id % 3 AS INTEGER) AS redirects FROM events""")
def probe_lines(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    k = F.col("event_id")
    line = F.concat_ws("\t", k.cast("string"), F.concat(F.lit("u/"), F.col("user_id").cast("string")), (200 + k % 5).cast("string"),
                       F.floor("value").cast("string"), "event_type", F.lit("f"), (k % 3).cast("string"), F.lit(""))
    return TX.parse_probe_lines(e.select(line.alias("value"))).select("id", "url", "code", "bytes", "content_type", "redirects")


_LISTING = "SELECT event_id, strftime(ts, '%Y%m%d') AS run FROM events"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    run = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    key = F.concat(F.lit("<Contents><Key>runs/"), run, F.lit("/"), F.col("event_id").cast("string"), F.lit("</Key></Contents>"))
    return X.table(spark, d, "events").select("event_id", F.concat(key, key).alias("value"))


@query("s14_listing_keys", "S14", f"SELECT event_id, 'runs/' || run || '/' || event_id AS key FROM ({_LISTING}), (SELECT unnest([1,2]))")
def listing_keys(spark: SparkSession, d: str) -> DataFrame:
    return TX.listing_keys(_listing(spark, d))


@query("t6_latest_runs", "T6 S14", f"SELECT DISTINCT run FROM ({_LISTING}) ORDER BY run DESC LIMIT 3")
def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return TX.latest_runs(_listing(spark, d))


_CAT = values([(i, r[0], r[5], r[6]) for i, r in enumerate(C.SITES)], "ord, id, slat, slon")


@query("s15_site_catalogue", "S15 J9", f"""WITH cat AS ({_CAT}), st AS (SELECT c_custkey AS station_id, 16.0::DOUBLE + (c_custkey*37 % 165)/10.0::DOUBLE AS lat,
      34.0::DOUBLE + (c_custkey*53 % 220)/10.0::DOUBLE AS lon FROM customer),
    dist AS (SELECT station_id, id, ord, 2*6371*asin(sqrt(least(1,pow(sin(radians(slat-lat)/2),2)+cos(radians(lat))*cos(radians(slat))*pow(sin(radians(slon-lon)/2),2)))) AS km FROM st, cat)
    SELECT station_id, id AS site, round(km,3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, ord) AS rn FROM dist WHERE km <= 400) WHERE rn=1""")
def site_catalogue(spark: SparkSession, d: str) -> DataFrame:
    cat = site_dimension(spark).select(F.monotonically_increasing_id().alias("ord"), "id", "lat", "lon")
    near = k_nearest(X.stations(spark, d).select("station_id", "lat", "lon"), cat, 1, 400.0)
    return rounded(near.filter(F.col("entry").isNotNull()).select(
        "station_id", F.col("entry.id").alias("site"), F.col("distance").alias("km")), 3)


@query("k3_numbered_chunks", "K3", """WITH RECURSIVE body AS (SELECT doc_id, source, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS b FROM documents),
    cut AS (SELECT doc_id, source, 0 AS pos, 0 AS s, CASE WHEN length(b) <= 1400 THEN length(b) WHEN strpos(reverse(substr(b, 951, 250)), ' ') > 0 THEN 1200-strpos(reverse(substr(b, 951, 250)), ' ') ELSE 1200 END AS e FROM body
      UNION ALL
      SELECT doc_id, source, pos+1, s2, CASE WHEN s2+1200 >= n THEN n WHEN strpos(reverse(substr(b, s2+951, 250)), ' ') > 0 THEN s2+1200-strpos(reverse(substr(b, s2+951, 250)), ' ') ELSE s2+1200 END
      FROM (SELECT c.*, greatest(c.e-150, c.s+1) AS s2, b, length(b) AS n FROM cut c JOIN body USING (doc_id) WHERE c.e < length(b))),
    pieces AS (SELECT doc_id, source, pos, trim(substr(b, s+1, e-s)) AS piece FROM cut JOIN body USING (doc_id, source))
    SELECT doc_id, pos, 'chunk-' || lpad(CAST(row_number() OVER (ORDER BY doc_id, pos) AS VARCHAR), 5, '0') AS id, length(piece) AS chars, md5(piece) AS digest
    FROM pieces WHERE length(piece) >= 60""")
def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk_pages(X.documents(spark, d).select("doc_id", "source", "text"))
    balance = F.col("doc_id") + F.col("pos") / 1e7
    return K.numbered_chunks(chunks, ["doc_id", "pos"], balance).select(
        "doc_id", "pos", "id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("k1_csv_round_trip", "K1 S5", sql("daily_n", "SELECT CAST(site_id AS VARCHAR) AS site, date, round(pm10_max,6) AS pm10_max, round(precip_mm,6) AS precip_mm, dayofyear(date) AS doy FROM daily_n"))
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    days = X.daily(spark, d, with_nulls=True).select(F.col("site_id").alias("site"), "date", "pm10_max", "precip_mm")
    folder = scratch(spark)
    K.write_csv(days, folder, ["site", "date"])
    back = TX.read_daily_csv(spark, folder, ["site", "date", "pm10_max", "precip_mm"])
    return rounded(back.withColumn("doy", F.col("doy").cast("long")), 6)


@query("k5_staged_pulls", "K5", sql("daily", "SELECT site_id, date, round(pm10_mean + CASE WHEN site_id % 3 = 0 THEN 1 ELSE 0 END,6) AS pm10_mean FROM daily"))
def staged_pulls(spark: SparkSession, d: str) -> DataFrame:
    days = X.daily(spark, d).select("site_id", "date", "pm10_mean")
    folder = scratch(spark)
    K.stage_site_pulls(days.repartition("site_id"), folder)
    again = days.filter(F.col("site_id") % 3 == 0).withColumn("pm10_mean", F.col("pm10_mean") + 1)
    K.stage_site_pulls(again.repartition("site_id"), folder)
    return rounded(spark.read.parquet(folder).withColumn("site_id", F.col("site_id").cast("long")), 6)


@query("k6_threshold_table", "K6 A4", sql("thresholds", "SELECT site_id, round(threshold,1) AS threshold FROM thresholds"))
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    """Written as the lookup table that serving reads, and read back."""
    folder = scratch(spark)
    K.write_thresholds(storm_thresholds(X.daily(spark, d), X.VAL_START), folder)
    return K.read_thresholds(spark, folder)


@query("t1_sorted_days", "T1 A12 U4", sql("daily_n", """SELECT count(*) AS n_rows, count(*) FILTER (pm10_max IS NOT NULL AND dust_max IS NOT NULL AND aod_mean IS NOT NULL AND ghi_mj_m2 IS NOT NULL
      AND gust_max_ms IS NOT NULL AND tmean_c IS NOT NULL) AS complete_rows, 0::BIGINT AS out_of_order FROM daily_n"""))
def complete(spark: SparkSession, d: str) -> DataFrame:
    """Days written in the order of site and date; the order is checked in the files."""
    folder = scratch(spark)
    K.write_sorted(X.daily(spark, d, with_nulls=True), folder, ["site_id", "date"])
    whole = complete_rows(spark.read.parquet(folder), ["pm10_max", "dust_max", "aod_mean", "ghi_mj_m2", "gust_max_ms", "tmean_c"])
    return whole.join(K.order_breaks(spark, folder, ["site_id", "date"]).select("out_of_order"))


@query("u4_duplicate_keys", "U4 A9", """SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS distinct_keys, CAST(sum(c) AS BIGINT) - count(*) AS duplicate_rows
    FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_suppkey, l_shipdate)""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return key_profile(X.table(spark, d, "lineitem"), ["l_suppkey", "l_shipdate"])
