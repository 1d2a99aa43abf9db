"""Column functions over the daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.functions import cleaning as CL
from dustspark.functions import physics as P
from dustspark.functions import scoring as SG
from dustspark.functions import soiling as S
from dustspark.operators import policy as PL
from dustspark.plans.catalog.base import (SQL_IRR, SQL_PR, SQL_WEATHER_RISK, pick, query, sql, sql_loss,
                                          sql_loss_risk, sql_risk_label)
from dustspark.sources import fixtures as X


@query("x1_day_angles", "X1", sql("daily", "SELECT DISTINCT date, round(sin(2*pi()*dayofyear(date)/365.25::DOUBLE),6) AS s0, round(cos(2*pi()*(dayofyear(date)-1)/365.25::DOUBLE),6) AS c1 FROM daily"))
def day_angles(spark: SparkSession, d: str) -> DataFrame:
    days = X.daily(spark, d).select("date").distinct()
    return pick(days, "date", F.sin(CL.doy_angle(F.col("date"))).alias("s0"), F.cos(CL.doy_angle(F.col("date"), 1)).alias("c1"), digits=6)


@query("x2_deposition_and_loss", "X2 X3 X4", sql("daily", """, r AS (SELECT site_id, date, 0.00042::DOUBLE*(0.42::DOUBLE*coalesce(dust_max,0)+0.16::DOUBLE*coalesce(pm10_max,0))*(1+least(2.2::DOUBLE,greatest(0,coalesce(g,3)-4)/6))/(1+2.6::DOUBLE*coalesce(precip_mm,0)) AS rate
      FROM (SELECT *, CASE WHEN dayofmonth(date) % 5 = 0 THEN NULL ELSE gust_max_ms END AS g FROM daily))
    SELECT site_id, date, round(rate,8) AS rate, round(98*(1-exp(-rate/30)),8) AS loss, round(98*(1-exp(-greatest(1,7.0::DOUBLE)*greatest(0,rate)/30))/100,8) AS factor FROM r"""))
def deposition(spark: SparkSession, d: str) -> DataFrame:
    gust = F.when(F.dayofmonth("date") % 5 != 0, F.col("gust_max_ms"))
    n = X.daily(spark, d).withColumn("rate", P.deposit_rate(F.col("pm10_max"), F.col("dust_max"), gust, F.col("precip_mm")))
    return pick(n, "site_id", "date", "rate", P.optical_loss_pct(F.col("rate")).alias("loss"),
                P.dust_factor_today(F.lit(7.0), F.col("rate")).alias("factor"), digits=8)


@query("x5_specific_yield", "X5 X15", sql("daily", """SELECT site_id, date, round(tmean_c+0.03125::DOUBLE*greatest(0,ghi_mj_m2*10),6) AS cell_c, round(CASE WHEN ghi_mj_m2 > 0 THEN ghi_mj_m2/3.6::DOUBLE*greatest(0.05::DOUBLE,0.8::DOUBLE*(1-0.0038::DOUBLE*(tmean_c+0.03125::DOUBLE*ghi_mj_m2/3.6::DOUBLE*1000/24*3-25))*(1-15.0::DOUBLE/100)) ELSE 0 END,6) AS kwh FROM daily"""))
def specific_yield(spark: SparkSession, d: str) -> DataFrame:
    return pick(X.daily(spark, d), "site_id", "date", P.cell_temp_c(F.col("tmean_c"), F.col("ghi_mj_m2") * 10).alias("cell_c"),
                P.specific_yield(F.col("ghi_mj_m2"), F.col("tmean_c"), F.lit(15.0)).alias("kwh"), digits=6)


@query("x7_loss_mass_marginal", "X7 X8 X9", sql("daily sites clim", f"""SELECT site_id, date, round({sql_loss('pm10_mean')},6) AS loss_pct, round(-9*ln(greatest(1e-6, 1-least(greatest({sql_loss('pm10_mean')},0),99)/100)),6) AS mass,
      round(100*(lmax/tau)*exp(-pm10_mean/tau),8) AS marginal FROM daily JOIN sites USING (site_id) JOIN clim USING (climate)"""))
def loss_functions(spark: SparkSession, d: str) -> DataFrame:
    n = PL.with_climate(X.daily(spark, d).join(X.sites(spark, d).select("site_id", "climate"), "site_id"))
    loss = S.loss_pct(F.col("pm10_mean"), F.col("lmax"), F.col("tau"))
    out = n.select("site_id", "date", loss.alias("loss_pct"), S.mass_from_loss(loss).alias("mass"),
                   S.marginal_loss(F.col("pm10_mean"), F.col("lmax"), F.col("tau")).alias("marginal"))
    return out.select("site_id", "date", F.round("loss_pct", 6).alias("loss_pct"), F.round("mass", 6).alias("mass"), F.round("marginal", 8).alias("marginal"))


@query("x11_energy", "X11", sql("rollup sites", f"""SELECT site_id, date, round({SQL_PR},6) AS ratio, round(capacity_kwp*{SQL_IRR}*{SQL_PR}*(1-0.1::DOUBLE),3) AS kwh FROM (
      SELECT r.site_id, date, capacity_kwp, CASE WHEN dayofmonth(date) % 6 = 0 THEN NULL ELSE irradiation_kwh_m2 END AS irradiation_kwh_m2, CASE WHEN dayofmonth(date) % 4 = 0 THEN 55.0::DOUBLE END AS tcell_max_c, CASE WHEN dayofmonth(date) % 3 = 0 THEN 0.0::DOUBLE ELSE tair_max_c END AS tair_max_c,
        pm10_ugm3 AS peak_ghi_wm2 FROM rollup r JOIN sites USING (site_id))"""))
def energy(spark: SparkSession, d: str) -> DataFrame:
    day = F.dayofmonth("date")
    n = X.rollup(spark, d).join(X.sites(spark, d).select("site_id", "capacity_kwp"), "site_id")
    irr = S.day_irradiation(F.when(day % 6 != 0, F.col("irradiation_kwh_m2")), F.col("pm10_ugm3"))
    ratio = S.performance_ratio(F.when(day % 4 == 0, 55.0), F.when(day % 3 == 0, 0.0).otherwise(F.col("tair_max_c")), F.col("pm10_ugm3"))
    return n.select("site_id", "date", F.round(ratio, 6).alias("ratio"), F.round(F.col("capacity_kwp") * irr * ratio * 0.9, 3).alias("kwh"))


@query("x13_risk_labels", "X13 A25", sql("rollup", f"""SELECT site_id, date, {sql_risk_label('(' + SQL_WEATHER_RISK + '+' + sql_loss_risk('rh_mean_pct/2') + ')')} AS risk FROM rollup"""))
def risk_labels(spark: SparkSession, d: str) -> DataFrame:
    score = S.weather_risk_score(F.col("gust_max_ms"), F.col("pm10_ugm3"), F.col("aod")) + S.loss_risk_score(F.col("rh_mean_pct") / 2)
    return X.rollup(spark, d).select("site_id", "date", S.risk_label(score).alias("risk"))


@query("x14_storm_levels", "X14", sql("scored", """SELECT site_id, date, CASE WHEN p >= greatest(0.4::DOUBLE+(site_id % 4)/10.0::DOUBLE,0.5::DOUBLE) THEN 'storm likely' WHEN p >= 0.6::DOUBLE*(0.4::DOUBLE+(site_id % 4)/10.0::DOUBLE) THEN 'watch' ELSE 'quiet' END AS level FROM scored"""))
def storm_levels(spark: SparkSession, d: str) -> DataFrame:
    from dustspark.plans.catalog.evaluation import scored
    return scored(spark, d).select("site_id", "date", SG.storm_level(F.col("p"), 0.4 + (F.col("site_id") % 4) / 10.0).alias("level"))


@query("x16_balance_kernel", "X16", sql("daily", """SELECT site_id, date, round(0.25::DOUBLE+0.75::DOUBLE*exp(-0.5::DOUBLE*pow(ln(greatest(wind_max_ms,0.5::DOUBLE)/3.6::DOUBLE/5.5::DOUBLE)/0.85::DOUBLE,2)),8) AS wind_factor, round(1+0.35::DOUBLE*greatest(rh_mean_pct-40,0)/60,8) AS cementation,
      round(0.08::DOUBLE*1.1::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*exp(-0.5::DOUBLE*pow(ln(greatest(wind_max_ms,0.5::DOUBLE)/3.6::DOUBLE/5.5::DOUBLE)/0.85::DOUBLE,2)))*pow(greatest(pm10_mean,5)/100,1.15::DOUBLE),8) AS flux,
      round(100*(1-exp(-0.81::DOUBLE*0.5::DOUBLE*(1+0.35::DOUBLE*greatest(rh_mean_pct-40,0)/60))),6) AS loss FROM daily"""))
def balance_kernel(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d)
    return n.select("site_id", "date", F.round(P.wind_deposition(F.col("wind_max_ms")), 8).alias("wind_factor"), F.round(P.cementation(F.col("rh_mean_pct")), 8).alias("cementation"),
                    F.round(P.deposition_flux(F.col("pm10_mean"), F.col("wind_max_ms"), 1.1), 8).alias("flux"), F.round(P.mass_loss_pct(F.lit(0.5), F.col("rh_mean_pct")), 6).alias("loss"))


@query("x21_batch_economics", "X21", sql("daily", """SELECT site_id, date, round(0.99::DOUBLE*loss/100,6) AS value_lost_day, round(0.99::DOUBLE*loss/100*365,7) AS value_lost_year, round(be,4) AS break_even_pct, round(rate,6) AS rate_pct_per_day,
      round(least(greatest(least(100,loss+rate*7*0.5::DOUBLE)/be,0),1),9) AS urgency, CAST(CASE WHEN loss >= be THEN 0 ELSE least(greatest(ceil((be-loss)/greatest(rate,1e-6)),0),365) END AS INTEGER) AS days_until_clean
    FROM (SELECT *, greatest(loss/greatest(dsc,1),0.05::DOUBLE) AS rate, 1.0::DOUBLE/(5.5::DOUBLE*0.18::DOUBLE*7)*100 AS be FROM (SELECT site_id, date, aod_mean*ghi_mj_m2 AS loss, tmean_c-15 AS dsc FROM daily))"""))
def batch_economics(spark: SparkSession, d: str) -> DataFrame:
    n = X.daily(spark, d)
    e = SG.batch_economics(F.col("aod_mean") * F.col("ghi_mj_m2"), F.col("tmean_c") - 15)
    digits = {"value_lost_day": 6, "value_lost_year": 7, "break_even_pct": 4, "rate_pct_per_day": 6, "urgency": 9}
    return n.select("site_id", "date", *[(F.round(c, digits[k]) if k in digits else c).alias(k) for k, c in e.items()])


@query("x22_confidence", "X22", sql("daily", """SELECT site_id, date, round(least(greatest((0.3::DOUBLE+(CASE WHEN aod_mean > 0.4 THEN 0.3::DOUBLE ELSE 0 END)+0.4::DOUBLE*exp(-(abs(ghi_mj_m2-tmean_c)/greatest(abs(0.5::DOUBLE*(ghi_mj_m2+tmean_c)),1))/0.35::DOUBLE))*(1-0.3::DOUBLE*least(rh_mean_pct/100,1)),0.05::DOUBLE),0.99::DOUBLE),6) AS confidence FROM daily"""))
def confidence(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("ghi_mj_m2"), F.col("tmean_c")
    c = SG.confidence(a, b, 0.5 * (a + b), F.col("aod_mean") > 0.4, F.col("rh_mean_pct") / 100)
    return pick(X.daily(spark, d), "site_id", "date", c.alias("confidence"), digits=6)
