"""Joins: assembly, lookups, nearest, as-of, leads, source health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.functions import soiling as S
from dustspark.functions.geo import mercator_pixel
from dustspark.operators import asof
from dustspark.operators import climatology as CLM
from dustspark.operators import daily as D
from dustspark.operators import features as FE
from dustspark.operators import mass_balance as MB
from dustspark.operators import nearest as N
from dustspark.operators import policy as PL
from dustspark.operators import profile as PR
from dustspark.plans.catalog.base import pick, query, rounded, sql
from dustspark.sources import fixtures as X
from dustspark.sources.dimensions import cleaning_presets

_HAV = "2*6371*asin(sqrt(least(1,pow(sin(radians({b}.lat-{a}.lat)/2),2)+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2),2))))"


def _feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = X.daily(spark, d)
    weather = n.select("site_id", "date", "ghi_mj_m2", "tmean_c")
    humid = n.filter(F.dayofmonth("date") % 4 != 0).select("site_id", "date", "rh_mean_pct")
    aerosol = n.filter(F.col("date") >= F.lit("1998-01-01").cast("date")).select("site_id", "date", "pm10_max", "pm10_mean")
    return weather, humid, aerosol


@query("j1_left_assembly", "J1", sql("daily", """SELECT site_id, date, round(ghi_mj_m2,4) AS ghi_mj_m2, round(tmean_c,4) AS tmean_c,
      CASE WHEN dayofmonth(date) % 4 <> 0 THEN round(rh_mean_pct,4) END AS rh_mean_pct,
      CASE WHEN date >= DATE '1998-01-01' THEN round(pm10_max,4) END AS pm10_max, CASE WHEN date >= DATE '1998-01-01' THEN round(pm10_mean,4) END AS pm10_mean FROM daily"""))
def left_assembly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.assemble_left(*_feeds(spark, d)))


@query("j2_inner_assembly", "J2", sql("daily", "SELECT site_id, date, round(ghi_mj_m2,4) AS ghi_mj_m2, round(tmean_c,4) AS tmean_c, round(pm10_max,4) AS pm10_max, round(pm10_mean,4) AS pm10_mean FROM daily WHERE date >= DATE '1998-01-01'"))
def inner_assembly(spark: SparkSession, d: str) -> DataFrame:
    weather, _, aerosol = _feeds(spark, d)
    return rounded(D.assemble_inner(weather, aerosol))


def _priority(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d)
    measured = n.filter(F.col("date") >= F.lit("1998-01-01").cast("date")).select("site_id", "date", "pm10_mean", "pm10_max")
    spine = n.select("site_id", "date")
    need = D.missing_days(spine, measured).filter(F.col("site_id") % 10 != 0)
    modelled = need.join(measured.groupBy("site_id").agg(F.avg("pm10_mean").alias("pm10_mean")), "site_id") \
        .withColumn("pm10_max", F.col("pm10_mean") * 1.7)
    return D.by_priority(spine, measured, modelled, ["pm10_mean", "pm10_max"])


_PRIORITY = """, meas AS (SELECT site_id, date, pm10_mean, pm10_max FROM daily WHERE date >= DATE '1998-01-01'),
    mdl AS (SELECT d.site_id, d.date, a.m AS pm10_mean, a.m*1.7::DOUBLE AS pm10_max FROM daily d JOIN (SELECT site_id, avg(pm10_mean) AS m FROM meas GROUP BY 1) a USING (site_id)
      WHERE d.date < DATE '1998-01-01' AND d.site_id % 10 <> 0),
    prio AS (SELECT d.site_id, d.date, coalesce(meas.pm10_mean, mdl.pm10_mean) AS pm10_mean, coalesce(meas.pm10_max, mdl.pm10_max) AS pm10_max,
      CASE WHEN meas.date IS NOT NULL THEN 'measured_cams' WHEN mdl.date IS NOT NULL THEN 'modelled_climatology' ELSE 'missing' END AS aq_source,
      CASE WHEN meas.date IS NOT NULL THEN 'open-meteo-archive+daily' ELSE 'open-meteo-archive+aq-climatology' END AS source
      FROM daily d LEFT JOIN meas USING (site_id, date) LEFT JOIN mdl USING (site_id, date)) """


@query("j3_priority_join", "J3 P13", sql("daily", _PRIORITY.lstrip() + "SELECT site_id, date, round(pm10_mean,4) AS pm10_mean, round(pm10_max,4) AS pm10_max, aq_source, source FROM prio"))
def priority(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_priority(spark, d))


@query("a11_join_coverage", "A11", sql("daily", _PRIORITY.lstrip() + """SELECT site_id, count(*) AS n_rows, count(*) FILTER (aq_source='measured_cams') AS measured_days,
      count(*) FILTER (aq_source='modelled_climatology') AS modelled_days, count(*) FILTER (aq_source='missing') AS missing_days FROM prio GROUP BY 1"""))
def join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return PR.coverage(_priority(spark, d))


@query("j4_missing_days", "J4 U2", sql("daily", "SELECT site_id, date FROM daily WHERE date < DATE '1998-01-01'"))
def missing_days(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d).select("site_id", "date")
    return D.missing_days(n, n.filter(F.col("date") >= F.lit("1998-01-01").cast("date")))


@query("j5_site_factor", "J5", sql("sites", """SELECT site_id, CASE WHEN site_id % 3 = 0 THEN 0.3::DOUBLE + site_id/1000.0::DOUBLE ELSE CASE CASE WHEN site_id % 7 = 1 THEN 'elsewhere' ELSE region END WHEN 'west' THEN 0.55::DOUBLE WHEN 'east' THEN 1.10::DOUBLE
      WHEN 'central' THEN 0.60::DOUBLE WHEN 'north' THEN 0.55::DOUBLE WHEN 'northwest' THEN 0.45::DOUBLE WHEN 'southwest_highland' THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END END AS site_factor FROM sites"""))
def site_factor(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    fitted = s.filter(F.col("site_id") % 3 == 0).select("site_id", (0.3 + F.col("site_id") / 1000.0).alias("site_factor"))
    odd = s.withColumn("region", F.when(F.col("site_id") % 7 == 1, "elsewhere").otherwise(F.col("region")))
    return MB.site_factor(odd, fitted).select("site_id", "site_factor")


@query("j6_climate_parameters", "J6", sql("sites clim", "SELECT site_id, climate, rate_pct_per_day, lmax, round(tau,2) AS tau, dust_bias, literature_pct FROM sites JOIN clim USING (climate)"))
def climate_parameters(spark: SparkSession, d: str) -> DataFrame:
    return PL.with_climate(X.sites(spark, d), "inland").select(
        "site_id", "climate", "rate_pct_per_day", "lmax", F.round("tau", 2).alias("tau"), "dust_bias", "literature_pct")


@query("j7_site_resolution", "J7", sql("sites", """, q AS (SELECT DISTINCT lower(right(s_name, 3)) AS query FROM supplier UNION SELECT 'nowhere' UNION SELECT '7')
    SELECT query, CAST(min(site_id) AS DOUBLE) AS site_id FROM (SELECT query, s.site_id FROM q LEFT JOIN sites s ON query = CAST(site_id AS VARCHAR) OR contains(lower(s.name), query)) GROUP BY 1""".replace(", q AS", ", q AS", 1).lstrip()))
def site_resolution(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    asked = s.select(F.lower(F.right("name", F.lit(3))).alias("query")).union(
        spark.createDataFrame([("nowhere",), ("7",)], "query string")).distinct()
    found = N.resolve_names(asked, s.select(F.col("site_id").alias("ord"), "site_id", "name"))
    return found.select("query", F.col("site.site_id").cast("double").alias("site_id"))


_STATION_SITES = """, pts AS (SELECT station_id, lat + (station_id % 7)*0.4::DOUBLE AS lat, lon - (station_id % 5)*0.5::DOUBLE AS lon FROM stations),
    dist AS (SELECT p.station_id, s.site_id, s.climate, {hav} AS km, (s.lat-p.lat)*(s.lat-p.lat)+(s.lon-p.lon)*(s.lon-p.lon) AS d2 FROM pts p, sites s) """.replace("{hav}", _HAV.format(a="p", b="s"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("station_id")
    return X.stations(spark, d).select(k, (F.col("lat") + (k % 7) * 0.4).alias("lat"), (F.col("lon") - (k % 5) * 0.5).alias("lon"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    return X.sites(spark, d).select(F.col("site_id").alias("ord"), "site_id", "climate", "lat", "lon")


@query("j8_coordinate_snap", "J8", sql("stations sites", _STATION_SITES.lstrip() + """SELECT p.station_id, coalesce(CAST(b.site_id AS VARCHAR), 'custom') AS site, coalesce(b.climate, 'inland') AS climate, round(b.km,3) AS distance_km
    FROM pts p LEFT JOIN (SELECT * FROM dist WHERE km <= 60 QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY km, site_id) = 1) b USING (station_id)"""))
def coordinate_snap(spark: SparkSession, d: str) -> DataFrame:
    out = N.snap_sites(_points(spark, d), _catalogue(spark, d), 60.0)
    return rounded(out.drop("lat", "lon"), 3)


@query("j9_nearest_site", "J9 X19", sql("stations sites", _STATION_SITES.lstrip() + """SELECT station_id, site_id, round(km,3) AS distance_km FROM dist WHERE km <= 400
    QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY km, site_id) = 1"""))
def nearest_site(spark: SparkSession, d: str) -> DataFrame:
    near = N.k_nearest(_points(spark, d), _catalogue(spark, d), 1, 400.0)
    return rounded(near.filter(F.col("entry").isNotNull()).select(
        "station_id", F.col("entry.site_id").alias("site_id"), F.col("distance").alias("distance_km")), 3)


_KNN = """, st AS (SELECT station_id, lat, lon, row_number() OVER (PARTITION BY lat, lon ORDER BY station_id) AS k FROM stations),
    dist AS (SELECT s.site_id, t.station_id, t.lat, t.lon, round({hav}, 1) AS km, {hav} AS raw FROM sites s, stations t) """.replace("{hav}", _HAV.format(a="s", b="t"))


@query("j10_nearest_stations", "J10 Q5", sql("stations sites", _KNN.lstrip() + """SELECT site_id, 'nearest' AS list, station_id, km, pos FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY km, station_id) AS pos FROM dist WHERE raw <= 1500) WHERE pos <= 3
    UNION ALL SELECT site_id, 'inside' AS list, station_id, km, pos FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY km, station_id) AS pos FROM dist WHERE raw <= 1500 AND lat BETWEEN 16 AND 32.5 AND lon BETWEEN 34 AND 56) WHERE pos <= 8"""))
def nearest_stations(spark: SparkSession, d: str) -> DataFrame:
    from dustspark.plans.reports import station_report
    return station_report(X.sites(spark, d).select("site_id", "lat", "lon"),
                          X.stations(spark, d).select(F.col("station_id").alias("ord"), "station_id", "lat", "lon"))


@query("j11_threshold_fallback", "J11", sql("stations sites thresholds", _STATION_SITES.lstrip() + """SELECT station_id, b.site_id AS nearest_site_id, round(CASE WHEN threshold > 0 AND b.site_id % 6 <> 0 THEN threshold ELSE 300 END,4) AS threshold
    FROM (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY d2, site_id) = 1) b LEFT JOIN thresholds USING (site_id)"""))
def threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    thr = FE.storm_thresholds(X.daily(spark, d), X.VAL_START).withColumn(
        "threshold", F.when(F.col("site_id") % 6 == 0, 0.0).otherwise(F.col("threshold")))
    return pick(N.site_thresholds_for(_points(spark, d), _catalogue(spark, d), thr), "station_id", "nearest_site_id", "threshold")


@query("j12_newest_imagery", "J12", """WITH av AS (SELECT DISTINCT user_id % 8 AS layer, CAST(ts AS DATE) AS date FROM events WHERE event_id % 3 = 0 AND (user_id % 8 <> 3 OR event_id % 30 = 0)),
    rq AS (SELECT DISTINCT user_id AS request_id, user_id % 8 AS layer, CASE WHEN user_id % 8 >= 6 THEN 'monthly' ELSE 'daily' END AS kind, CAST(ts AS DATE) + 5 AS date FROM events)
    SELECT request_id, layer, kind, rq.date, max(av.date) AS effective_date FROM rq LEFT JOIN av ON av.layer = rq.layer AND
      CASE WHEN kind = 'daily' THEN av.date BETWEEN rq.date - 20 AND rq.date
           ELSE dayofmonth(av.date) = 1 AND av.date BETWEEN date_trunc('month', rq.date) - INTERVAL 24 MONTH AND date_trunc('month', rq.date) END
    GROUP BY ALL""".replace("SELECT request_id, layer,", "SELECT request_id, rq.layer AS layer,"))
def newest_imagery(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    layer, day = F.col("user_id") % 8, F.to_date("ts")
    av = e.filter((F.col("event_id") % 3 == 0) & ((layer != 3) | (F.col("event_id") % 30 == 0))).select(layer.alias("layer"), day.alias("date"))
    rq = e.select(F.col("user_id").alias("request_id"), layer.alias("layer"), F.when(layer >= 6, "monthly").otherwise("daily").alias("kind"),
                  F.date_add(day, 5).alias("date")).distinct()
    return asof.newest_available(rq, av).select("request_id", "layer", "kind", "date", "effective_date")


@query("j14_site_pairs", "J14", sql("rollup sites", """, m AS (SELECT site_id, avg(pm10_ugm3) AS pm FROM rollup GROUP BY 1)
    SELECT a.site_id AS site_a, b.site_id AS site_b, round(ma.pm,4) AS pm_a, round(mb.pm,4) AS pm_b, round(ma.pm-mb.pm,4) AS difference
    FROM sites a JOIN sites b ON b.site_id = a.site_id + 1 JOIN m ma ON ma.site_id=a.site_id JOIN m mb ON mb.site_id=b.site_id""".lstrip()))
def site_pairs(spark: SparkSession, d: str) -> DataFrame:
    from dustspark.plans.reports import compare_pairs
    means = X.rollup(spark, d).groupBy("site_id").agg(F.avg("pm10_ugm3").alias("pm"))
    pairs = X.sites(spark, d).select(F.col("site_id").alias("site_a"), (F.col("site_id") + 1).alias("site_b"))
    out = compare_pairs(pairs, means)
    return pick(out, "site_a", "site_b", F.col("a.pm").alias("pm_a"), F.col("b.pm").alias("pm_b"),
                (F.col("a.pm") - F.col("b.pm")).alias("difference"))


@query("j16_sites_by_calendar", "J16 X10 X18", sql("sites clim", """SELECT site_id, date, round((1+0.65::DOUBLE*exp(-pow((doy-60)/45.0::DOUBLE,2))+0.35::DOUBLE*exp(-pow((doy-300)/32.0::DOUBLE,2)))*dust_bias,6) AS f,
      round(irr_winter+(irr_summer-irr_winter)*(1+cos(2*pi()*(doy-180)/365))/2,6) AS irr
    FROM (SELECT *, dayofyear(date) AS doy FROM (SELECT site_id, dust_bias, irr_summer, irr_winter, CAST(unnest(range(DATE '2026-01-01', DATE '2027-01-01', INTERVAL 1 DAY)) AS DATE) AS date FROM sites JOIN clim USING (climate)))"""))
def sites_by_calendar(spark: SparkSession, d: str) -> DataFrame:
    days = PL.calendar_year(PL.with_climate(X.sites(spark, d).select("site_id", "climate")))
    return pick(days, "site_id", "date", (S.season_factor(F.col("doy")) * F.col("dust_bias")).alias("f"),
                S.year_irradiation(F.col("doy"), F.col("irr_summer"), F.col("irr_winter")).alias("irr"), digits=6)


def source_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = X.table(spark, d, "events")
    registry = X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 4 == 0, "API_KEY").otherwise("open").alias("access"))
    probes = e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("checked"),
                      F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 204)
                      .otherwise(200).alias("http"), F.floor("value").alias("bytes"))
    return registry, probes


_HEALTH = """h AS (SELECT c.c_custkey AS source_id, c.c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'API_KEY' ELSE 'open' END AS access,
      CASE WHEN c_custkey % 4 = 0 THEN 'gated' WHEN p.http IS NULL THEN 'unreachable' WHEN http = 200 THEN 'live' WHEN http = 204 THEN 'no_data' ELSE 'error' END AS status,
      CAST(CASE WHEN c_custkey % 4 <> 0 THEN http END AS DOUBLE) AS http, CAST(CASE WHEN c_custkey % 4 <> 0 THEN bytes END AS DOUBLE) AS bytes
    FROM customer c LEFT JOIN (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 204 ELSE 200 END AS http, CAST(floor(value) AS BIGINT) AS bytes FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) p ON p.user_id = c.c_custkey)"""


@query("j17_source_health", "J17 Q6", f"WITH {_HEALTH} SELECT * FROM h")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    health = asof.source_health(*source_tables(spark, d))
    return health.withColumns({c: F.col(c).cast("double") for c in ("http", "bytes")})


@query("a22_source_summary", "A22", f"WITH {_HEALTH} SELECT count(*) FILTER (status='live') AS open_live, count(*) FILTER (access='open') AS open_total, count(*) FILTER (status='gated') AS gated FROM h")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    return asof.health_summary(asof.source_health(*source_tables(spark, d)))


@query("w19_feasible_dates", "W19", sql("daily", """SELECT site_id, date, CASE WHEN site_id % 3 = 0 THEN 'monthly' ELSE 'daily' END AS kind,
      CAST(CASE WHEN site_id % 3 = 0 THEN date_trunc('month', date) ELSE date - 3 END AS DATE) AS feasible FROM daily"""))
def feasible_dates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("site_id") % 3 == 0, "monthly").otherwise("daily")
    return X.daily(spark, d).select("site_id", "date", kind.alias("kind"), asof.feasible_date(kind, F.col("date")).alias("feasible"))


@query("x20_tile_cover", "X20", sql("sites", """, px AS (SELECT site_id, (lon+180)/360*256*pow(2,z) AS x, (0.5::DOUBLE-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*256*pow(2,z) AS y FROM (SELECT *, 4 + site_id % 4 AS z FROM sites))
    SELECT site_id, round(x,3) AS x, round(y,3) AS y, tile_x, unnest(range(y0, y1+1)) AS tile_y FROM (SELECT *, unnest(range(x0, x1+1)) AS tile_x FROM (
      SELECT *, CAST(floor((x-320)/256) AS BIGINT) AS x0, CAST(floor((x+320)/256) AS BIGINT) AS x1, CAST(floor((y-200)/256) AS BIGINT) AS y0, CAST(floor((y+200)/256) AS BIGINT) AS y1 FROM px)
      WHERE (x1-x0+1)*(y1-y0+1) <= 64)""".lstrip()))
def tile_cover(spark: SparkSession, d: str) -> DataFrame:
    s = X.sites(spark, d)
    x, y = mercator_pixel(F.col("lat"), F.col("lon"), 4 + F.col("site_id") % 4)
    return rounded(N.tile_cover(s.select("site_id", x.alias("x"), y.alias("y")), 640, 400), 3)


@query("x12_cleaning_presets", "X12", sql("sites", """SELECT site_id, preset, round(greatest(capacity_kwp/1000,0.001::DOUBLE)*sar,2) AS dry_sar, round(greatest(capacity_kwp/1000,0.001::DOUBLE)*sar*1.45::DOUBLE,2) AS wet_sar,
      round(2500*capacity_kwp/1000,2) AS water_litres FROM sites, (VALUES ('dry_saudi',1800.0::DOUBLE),('robotic',600.0::DOUBLE),('manual_iea',5100.0::DOUBLE)) p(preset, sar)"""))
def presets(spark: SparkSession, d: str) -> DataFrame:
    both = X.sites(spark, d).crossJoin(F.broadcast(cleaning_presets(spark)))
    cap, rate = F.col("capacity_kwp"), F.col("sar_per_mwp")
    return pick(both, "site_id", "preset", S.cleaning_cost(cap, rate).alias("dry_sar"), S.cleaning_cost(cap, rate, wet=True).alias("wet_sar"),
                S.water_litres(cap).alias("water_litres"), digits=2)


_GRAMSQL = ", ".join([f"round(sum(x{i}*x{j}),4) AS g{i}{j}" for i in range(5) for j in range(i, 5)] + [f"round(sum(x{i}*ln(pm10_mean)),4) AS m{i}" for i in range(5)])


@query("a26_gram_sums", "A26", sql("daily_n", f"""SELECT site_id, count(*) AS n_fit, round(sum(ln(pm10_mean)*ln(pm10_mean)),4) AS yy, round(median(pm10_mean),4) AS median_pm10, {_GRAMSQL}
    FROM (SELECT *, 1.0::DOUBLE AS x0, cos(t) AS x1, sin(t) AS x2, cos(2*t) AS x3, sin(2*t) AS x4 FROM (SELECT *, 2*pi()*(dayofyear(date)-1)/365.25::DOUBLE AS t FROM daily_n WHERE pm10_mean > 0)) GROUP BY 1 HAVING count(*) >= 60"""))
def gram_sums(spark: SparkSession, d: str) -> DataFrame:
    return rounded(CLM.gram_sums(X.daily(spark, d, with_nulls=True)))


@query("a26_seasonal_fit", "A26")
def seasonal_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = CLM.fit_climatology(X.daily(spark, d, with_nulls=True))
    return rounded(fit.select("site_id", "n_fit", "median_pm10", "sigma_log", *[F.col("coef")[i].alias(f"c{i}") for i in range(5)]))


@query("x17_climatology_backfill", "X17")
def climatology_backfill(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d)
    late = n.filter(F.col("date") >= F.lit("1998-01-01").cast("date"))
    need = D.missing_days(n.select("site_id", "date"), late)
    return rounded(CLM.backfill(need, CLM.fit_climatology(late)))


@query("x17_backfill_ratios", "X17", sql("daily", """SELECT site_id, date, round(pm10_mean*1.7::DOUBLE,6) AS pm10_max, round(pm10_mean*0.32::DOUBLE,6) AS pm25_mean, round(pm10_mean*0.32::DOUBLE*1.8::DOUBLE,6) AS pm25_max, round(pm10_mean*0.55::DOUBLE,6) AS dust_mean,
      round(pm10_mean*0.55::DOUBLE*1.9::DOUBLE,6) AS dust_max, round(least(1.2::DOUBLE,0.0016::DOUBLE*pm10_mean+0.06::DOUBLE),6) AS aod_mean, round(least(1.6::DOUBLE,0.0021::DOUBLE*pm10_mean+0.09::DOUBLE),6) AS aod_max,
      round(3+0.2::DOUBLE*cos(t)-0.1::DOUBLE*sin(t)+0.05::DOUBLE*cos(2*t)+0.02::DOUBLE*sin(2*t),6) AS seasonal FROM (SELECT *, 2*pi()*(dayofyear(date)-1)/365.25::DOUBLE AS t FROM daily)"""))
def backfill_ratios(spark: SparkSession, d: str) -> DataFrame:
    from dustspark.functions.physics import backfill_from_pm10, seasonal_value
    n = X.daily(spark, d)
    coef = F.array(*[F.lit(v) for v in (3.0, 0.2, -0.1, 0.05, 0.02)])
    cols = {k: v for k, v in backfill_from_pm10(F.col("pm10_mean")).items() if k != "pm10_mean"}
    return rounded(n.select("site_id", "date", *[c.alias(k) for k, c in cols.items()],
                            seasonal_value(F.dayofyear("date"), coef).alias("seasonal")), 6)
