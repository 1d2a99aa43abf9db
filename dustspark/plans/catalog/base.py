"""Registry of checkable queries, with the shared table expressions of their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark import constants as C
from dustspark.plans.catalog.dates import DATED

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    covers: tuple[str, ...]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query under a name, with the inventory ids it covers and its SQL, if there is one."""
    dates = DATED.get(name, ())

    def keep(run: Run) -> Run:
        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        shown = run
        text = sql
        if dates:
            def shown(spark: SparkSession, folder: str) -> DataFrame:
                return run(spark, folder).withColumns({c: F.col(c).cast("string") for c in dates})
            text = "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates) + f") FROM ({sql})"
        CATALOG[name] = Query(shown, tuple(covers.split()), text)
        return run
    return keep


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """All double columns rounded once, at the edge."""
    return df.select(*[
        F.round(F.col(c), special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def settled(value: Column, digits: int) -> Column:
    """Rounding for values with few decimals: a nudge keeps exact halves from depending on the last bit."""
    return F.round(value + 1e-9, digits)


def pick(df: DataFrame, *columns: str | Column, digits: int = 4) -> DataFrame:
    return rounded(df.select(*columns), digits)


def values(rows: list[tuple], names: str) -> str:
    def lit(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


_CLIMATE_ROWS = [(n, r, lm, round(lm / (r / 100.0), 10), b, lit_, pr, s, w) for n, r, lm, b, lit_, pr, s, w in C.CLIMATES]
_CANDIDATES = ([(i, "interval", k, None) for i, k in enumerate(C.INTERVAL_CANDIDATES)]
               + [(len(C.INTERVAL_CANDIDATES) + i, "threshold", None, t) for i, t in enumerate(C.THRESHOLD_CANDIDATES)]
               + [(len(C.INTERVAL_CANDIDATES) + len(C.THRESHOLD_CANDIDATES), "never", None, None)])

# name -> (needed expressions, SQL)
CTES: dict[str, tuple[str, str]] = {
    "sites": ("", """SELECT s_suppkey AS site_id, s_name AS name,
        CASE s_nationkey % 4 WHEN 0 THEN 'west' WHEN 1 THEN 'east' WHEN 2 THEN 'inland' ELSE 'highland' END AS climate,
        CASE s_nationkey % 6 WHEN 0 THEN 'west' WHEN 1 THEN 'east' WHEN 2 THEN 'central' WHEN 3 THEN 'north'
            WHEN 4 THEN 'northwest' ELSE 'southwest_highland' END AS region,
        16.0::DOUBLE + (s_suppkey*37 % 165)/10.0::DOUBLE AS lat, 34.0::DOUBLE + (s_suppkey*53 % 220)/10.0::DOUBLE AS lon,
        1000.0::DOUBLE*(1 + s_suppkey % 50) AS capacity_kwp FROM supplier"""),
    "daily": ("", """SELECT l_suppkey AS site_id, CAST(l_shipdate AS DATE) AS date,
        max(l_quantity*l_quantity)*0.05::DOUBLE*(4 + l_suppkey % 9) AS pm10_max,
        avg(l_quantity)*(2 + l_suppkey % 5) AS pm10_mean,
        max(l_quantity)*6 AS dust_max, avg(l_quantity)*4 AS dust_mean, max(l_tax)*10 AS aod_mean,
        3 + max(l_discount)*150 AS gust_max_ms, 2 + max(l_discount)*120 AS wind_max_ms,
        sum(CASE WHEN l_returnflag='R' AND l_tax>=0.07::DOUBLE THEN l_quantity/4 ELSE 0 END) AS precip_mm,
        8.0::DOUBLE + max(l_partkey % 20) AS ghi_mj_m2, 15.0::DOUBLE + max(l_orderkey % 28) AS tmean_c,
        10.0::DOUBLE + max(l_partkey % 70) AS rh_mean_pct
        FROM lineitem GROUP BY 1, 2"""),
    "daily_n": ("daily", """SELECT * REPLACE (
        CASE WHEN (site_id*7 + dayofyear(date)) % 50 = 0 THEN NULL ELSE pm10_max END AS pm10_max,
        CASE WHEN (site_id*7 + dayofyear(date)) % 50 = 0 THEN NULL ELSE pm10_mean END AS pm10_mean) FROM daily"""),
    "hourly": ("", """SELECT user_id AS site_id, date_trunc('hour', ts) AS ts,
        avg(CASE event_type WHEN 'view' THEN value END) AS pm10, avg(CASE event_type WHEN 'click' THEN value END) AS dust_ugm3,
        avg(CASE event_type WHEN 'purchase' THEN value/100 END) AS aod, avg(CASE event_type WHEN 'signup' THEN value*8 END) AS ghi_wm2,
        avg(CASE event_type WHEN 'error' THEN value/4 END) AS temp_c FROM events GROUP BY 1, 2"""),
    "stations": ("", """SELECT c_custkey AS station_id, c_name AS name,
        16.0::DOUBLE + (c_custkey*37 % 165)/10.0::DOUBLE AS lat, 34.0::DOUBLE + (c_custkey*53 % 220)/10.0::DOUBLE AS lon,
        c_acctbal AS elev_m FROM customer"""),
    "rollup": ("daily", """SELECT site_id, date, ghi_mj_m2/3.6::DOUBLE AS irradiation_kwh_m2, tmean_c AS tair_max_c,
        CAST(NULL AS DOUBLE) AS tcell_max_c, CAST(NULL AS DOUBLE) AS peak_ghi_wm2, rh_mean_pct, wind_max_ms, gust_max_ms,
        precip_mm, pm10_mean AS pm10_ugm3, dust_mean AS dust_ugm3, aod_mean AS aod FROM daily"""),
    "clim": ("", values(_CLIMATE_ROWS, "climate, rate_pct_per_day, lmax, tau, dust_bias, literature_pct, year_pr, irr_summer, irr_winter")),
    "candidates": ("", values(_CANDIDATES, "ord, kind, interval_days, threshold_pct")),
    "thresholds": ("daily", """SELECT site_id, coalesce(greatest(3.0::DOUBLE * CASE WHEN nt > 0 THEN mt ELSE ma END, 300.0::DOUBLE), 300.0::DOUBLE) AS threshold
        FROM (SELECT site_id, count(*) FILTER (date < DATE '2000-01-01') AS nt,
            list_sort(list(pm10_max) FILTER (date < DATE '2000-01-01' AND pm10_max IS NOT NULL))[
              count(pm10_max) FILTER (date < DATE '2000-01-01') // 2 + 1] AS mt,
            list_sort(list(pm10_max) FILTER (pm10_max IS NOT NULL))[count(pm10_max) // 2 + 1] AS ma
          FROM daily GROUP BY 1)"""),
    "rated": ("daily", """SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date) AS rn,
        0.00042::DOUBLE*(0.42::DOUBLE*coalesce(dust_max,0)+0.16::DOUBLE*coalesce(pm10_max,0))
          *(1+least(2.2::DOUBLE, greatest(0, gust_max_ms-4)/6))/(1+2.6::DOUBLE*coalesce(precip_mm,0)) AS rate,
        sum(CASE WHEN coalesce(precip_mm,0) >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY site_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS seg
        FROM daily"""),
    "massed": ("rated thresholds", """SELECT r.*, threshold,
        sum(CASE WHEN coalesce(precip_mm,0) >= 1 THEN 0 ELSE rate END) OVER (PARTITION BY r.site_id, seg ORDER BY date ROWS 119 PRECEDING) AS mass,
        CASE WHEN coalesce(pm10_max,0) >= threshold THEN 1 ELSE 0 END AS storm
        FROM rated r JOIN thresholds USING (site_id)"""),
    "labelled": ("massed", """SELECT *, 98*(1-exp(-mass/30)) AS soiling,
        CASE WHEN coalesce(ghi_mj_m2,0) > 0 THEN ghi_mj_m2/3.6::DOUBLE * greatest(0.05::DOUBLE, 0.8::DOUBLE*(1-0.0038::DOUBLE*(
            tmean_c + 25.0::DOUBLE/800*greatest(0, ghi_mj_m2/3.6::DOUBLE*1000/24*3) - 25))*(1-98*(1-exp(-mass/30))/100)) ELSE 0 END AS yield_kwh
        FROM massed"""),
    "featured": ("labelled", """SELECT *,
        least(coalesce(rn - max(CASE WHEN coalesce(precip_mm,0) >= 1 THEN rn END) OVER w0, 120), 120)::DOUBLE AS days_since_rain,
        least(coalesce(rn - max(CASE WHEN coalesce(pm10_max,0) >= threshold THEN rn END) OVER w0, 120), 120)::DOUBLE AS days_since_storm,
        coalesce(max(pm10_max) OVER w3, 0) AS pm10_max_3d, coalesce(max(pm10_max) OVER w7, 0) AS pm10_max_7d,
        coalesce(max(pm10_max) OVER w30, 0) AS pm10_max_30d,
        coalesce(avg(dust_mean) OVER w7, 0) AS dust_mean_7d, coalesce(avg(dust_mean) OVER w30, 0) AS dust_mean_30d,
        coalesce(max(gust_max_ms) OVER w7, 0) AS gust_max_7d, coalesce(max(gust_max_ms) OVER w30, 0) AS gust_max_30d,
        coalesce(sum(precip_mm) OVER w7, 0) AS precip_7d, coalesce(sum(precip_mm) OVER w30, 0) AS precip_30d,
        coalesce(lag(pm10_max,1) OVER w, 0) AS pm10_max_lag1, coalesce(lag(pm10_max,2) OVER w, 0) AS pm10_max_lag2,
        coalesce(lag(pm10_max,3) OVER w, 0) AS pm10_max_lag3, coalesce(lag(dust_mean,1) OVER w, 0) AS dust_mean_lag1,
        coalesce(avg(aod_mean) OVER w7, 0) AS aod_mean_7d,
        sin(2*pi()*dayofyear(date)/365.25::DOUBLE) AS doy_sin, cos(2*pi()*dayofyear(date)/365.25::DOUBLE) AS doy_cos
        FROM labelled
        WINDOW w AS (PARTITION BY site_id ORDER BY date), w0 AS (PARTITION BY site_id ORDER BY date ROWS UNBOUNDED PRECEDING),
          w3 AS (PARTITION BY site_id ORDER BY date ROWS 2 PRECEDING), w7 AS (PARTITION BY site_id ORDER BY date ROWS 6 PRECEDING),
          w30 AS (PARTITION BY site_id ORDER BY date ROWS 29 PRECEDING)"""),
    "samples": ("featured", """SELECT * FROM (SELECT *,
        98*(1-exp(-greatest(1,days_since_rain)*greatest(0,rate)/30))/100 AS dust_factor_today,
        lead(storm,1) OVER w AS storm_t1, lead(storm,2) OVER w AS storm_t2, lead(storm,3) OVER w AS storm_t3,
        lead(yield_kwh) OVER w AS yield_t1, lead(coalesce(ghi_mj_m2,0)/3.6::DOUBLE) OVER w AS ghi_t1, lead(soiling) OVER w AS soiling_t1,
        lead(coalesce(pm10_max,0)) OVER w AS pm10_t1
        FROM featured WINDOW w AS (PARTITION BY site_id ORDER BY date)) WHERE rn > 45 AND storm_t3 IS NOT NULL"""),
    "scored": ("samples", """SELECT site_id, date, storm_t1 AS y, coalesce(pm10_max,0)/(coalesce(pm10_max,0)+threshold) AS p, storm, threshold,
        yield_t1, soiling_t1, ghi_mj_m2 FROM samples"""),
    "tok": ("", """SELECT doc_id, source, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.\\-_%]*'),
        lambda t: length(t) > 1 AND NOT list_contains([{stop}], t)) AS toks FROM documents""".replace(
            "{stop}", ", ".join(f"'{w}'" for w in C.STOP_WORDS))),
    "posts": ("tok", "SELECT doc_id, len(toks) AS dl, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM tok) GROUP BY 1, 2, 3"),
    "stats": ("tok", "SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM tok"),
    "idfs": ("posts stats", "SELECT term, df, ln(1+(n-df+0.5::DOUBLE)/(df+0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM posts GROUP BY 1), stats"),
    "qtok": ("", """SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.\\-_%]*'),
        lambda t: length(t) > 1 AND NOT list_contains([{stop}], t)) AS toks FROM benchmark""".replace(
            "{stop}", ", ".join(f"'{w}'" for w in C.STOP_WORDS))),
    "qterms": ("qtok", "SELECT query_id, term, 1+0.5::DOUBLE*count(*)/max(len(toks)) AS q_weight FROM (SELECT query_id, toks, unnest(toks) AS term FROM qtok) GROUP BY 1, 2"),
    "hits": ("posts idfs qterms stats", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS pos FROM (
        SELECT query_id, doc_id, sum(q_weight*idf*(tf*2.5::DOUBLE)/(tf+1.5::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/avg_len))) AS score
        FROM qterms JOIN posts USING (term) JOIN idfs USING (term), stats GROUP BY 1, 2)) WHERE score > 0 AND pos <= 6"""),
}


# features that the driver tables do not hold; they count as zero
_UNKNOWN = ("lat", "lon", "elevation_m", "tmax_c", "tmin_c", "wind_dir_deg", "pm25_mean")
SQL_FEATURES = ", ".join(f"0.0::DOUBLE AS {c}" if c in _UNKNOWN else f"round(CAST({c} AS DOUBLE),6) AS {c}" for c in C.FEATURES)


def sql(ctes: str, body: str, extra: str = "", recursive: bool = False) -> str:
    """WITH clause of the named expressions (and what they need), then ``extra`` CTEs, then the body."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in CTES[name][0].split():
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in ctes.split():
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered] + ([extra.strip().rstrip(",")] if extra else [])
    # a body may go on with further expressions by starting with a comma
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body


# ---- SQL text of shared expressions
def sql_dust_factor(bias: str = "dust_bias") -> str:
    w = ("least(greatest(coalesce(nullif(gust_max_ms,0), coalesce(nullif(wind_max_ms,0), 3.0::DOUBLE)), 0), 28.0::DOUBLE)")
    return (f"least(greatest({bias} * coalesce(least(greatest(coalesce(pm10_ugm3,dust_ugm3)/120, 0.2::DOUBLE), 5.0::DOUBLE), 1.0::DOUBLE)"
            f" * (CASE WHEN {w} <= 8 THEN 0.55::DOUBLE+0.075::DOUBLE*{w} ELSE greatest(0.35::DOUBLE, 1.15::DOUBLE-0.055::DOUBLE*({w}-8)) END)"
            " * (0.85::DOUBLE+0.006::DOUBLE*greatest(0, coalesce(nullif(rh_mean_pct,0),30)-25))"
            " * (0.9::DOUBLE+0.03::DOUBLE*least(greatest(coalesce(irradiation_kwh_m2,6),0),8.5::DOUBLE)), 0.05::DOUBLE), 3.5::DOUBLE)")


def sql_loss(exposure: str) -> str:
    return f"100*least(0.55::DOUBLE, lmax*(1-exp(-greatest(0,{exposure})/tau)))"


SQL_PR = ("least(greatest(0.8::DOUBLE*(1-0.004::DOUBLE*greatest(0, coalesce(tcell_max_c, coalesce(nullif(tair_max_c,0),35)"
          "+coalesce(nullif(peak_ghi_wm2,0),800)*0.028::DOUBLE)-25)), 0.45::DOUBLE), 0.95::DOUBLE)")
SQL_IRR = "coalesce(irradiation_kwh_m2, coalesce(nullif(peak_ghi_wm2,0),800)*6/1000)"


def sql_steps(v: str, low: float, high: float) -> str:
    return f"(CASE WHEN coalesce({v},0) >= {high}::DOUBLE THEN 2 WHEN coalesce({v},0) >= {low}::DOUBLE THEN 1 ELSE 0 END)"


SQL_WEATHER_RISK = (f"({sql_steps('gust_max_ms', 10, 14)}+{sql_steps('pm10_ugm3', 150, 250)}+{sql_steps('aod', 0.45, 0.8)})")


def sql_loss_risk(loss: str) -> str:
    return sql_steps(loss, 12, 25)


def sql_risk_label(score: str) -> str:
    return f"CASE WHEN {score} >= 5 THEN 'severe' WHEN {score} >= 3 THEN 'high' WHEN {score} >= 1 THEN 'moderate' ELSE 'low' END"
