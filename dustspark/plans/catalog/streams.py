"""Streaming queries: a finite stream of files is run to its end and its sink is read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dustspark.operators import schedule as SC
from dustspark.operators.features import with_threshold
from dustspark.plans.catalog.base import query, rounded, sql, sql_dust_factor
from dustspark.session import scratch
from dustspark.sources import fixtures as X
from dustspark.streaming import live as L


_LATENESS = "60 days"


_DAYS = """SELECT site_id, CAST(ts AS DATE) AS date, count(*) AS hours, round(avg(pm10),6) AS pm10_ugm3, round(avg(dust_ugm3),6) AS dust_ugm3, round(avg(aod),6) AS aod,
      round(sum(coalesce(ghi_wm2,0))/1000,6) AS irradiation_kwh_m2, round(max(temp_c),6) AS tair_max_c FROM hourly GROUP BY 1, 2"""


def _run_daily(spark: SparkSession, d: str, twice: bool) -> DataFrame:
    folder = scratch(spark)
    hours = X.hourly(spark, d)
    rows = hours.unionByName(hours) if twice else hours
    rows.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    stream = L.watch_hours(spark, f"{folder}/in", rows.schema, files_per_trigger=1)
    # the files come in no particular order, so the lateness spans the record
    days = L.daily_stream(L.unique_hours(stream, _LATENESS) if twice else stream, _LATENESS)
    L.run_available(days, f"{folder}/out", f"{folder}/ckpt")
    # a closing observation, delivered to the restarted stream, moves the watermark past the last real day
    hours.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("site_id"), (F.col("ts") + F.expr("interval 120 days")).alias("ts"),
        *[F.lit(None).cast("double").alias(c) for c in hours.columns if c not in ("site_id", "ts")],
    ).write.mode("append").parquet(f"{folder}/in")
    L.run_available(days, f"{folder}/out", f"{folder}/ckpt")
    return rounded(spark.read.parquet(f"{folder}/out").filter(F.col("site_id") >= 0), 6)


# some hours arrive days after their time; a file holds what arrives within three days
_SPAN, _ONE_DAY = 3, "1 day"
_ARRIVED = """, a AS (SELECT *, datediff('day', (SELECT min(CAST(ts AS DATE)) FROM hourly), CAST(ts AS DATE)) + CASE (site_id*7 + hour(ts)*3 + dayofyear(ts)) % 19 WHEN 0 THEN 6 WHEN 1 THEN 2 ELSE 0 END AS arrival FROM hourly),
    b AS (SELECT *, arrival // 3 AS batch FROM a),
    m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS passed FROM b GROUP BY 1),
    l AS (SELECT b.*, passed, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= passed, false) AS late FROM b JOIN m USING (batch))
    """


def _arrivals(hours: DataFrame) -> DataFrame:
    """Hours with the number of the file that they arrive in."""
    first = hours.agg(F.min(F.to_date("ts")).alias("_first"))
    odd = F.pmod(F.col("site_id") * 7 + F.hour("ts") * 3 + F.dayofyear("ts"), F.lit(19))
    arrival = F.datediff(F.to_date("ts"), "_first") + F.when(odd == 0, 6).when(odd == 1, 2).otherwise(0)
    return hours.join(F.broadcast(first)).withColumn("arrival", F.floor(arrival / _SPAN).cast("int")).drop("_first")


def _in_turn(rows: DataFrame, folder: str, closes: Column, lateness: str) -> DataFrame:
    """Delivers the rows by ``arrival``, a folder at a time, to a stream that diverts late ones; the stream of the others."""
    schema = rows.drop("arrival").schema
    rows.write.partitionBy("arrival").parquet(f"{folder}/sent")
    for (k,) in sorted(rows.select("arrival").distinct().collect()):  # as many as there are deliveries
        rows.sparkSession.read.schema(schema).parquet(f"{folder}/sent/arrival={k}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        L.divert_late(L.watch_hours(rows.sparkSession, f"{folder}/in", schema), folder, f"{folder}/ckpt-split", lateness, closes)
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("recursiveFileLookup", True).parquet(f"{folder}/ontime")


@query("r1_daily_stream", "R1", sql("hourly", _ARRIVED.lstrip() + _DAYS.replace("FROM hourly", "FROM l WHERE NOT late")))
def daily_stream(spark: SparkSession, d: str) -> DataFrame:
    """Days rolled up from hours that arrive in turn, a lateness of one day; later hours are in no day (see r1_late_hours)."""
    folder = scratch(spark)
    hours = _arrivals(X.hourly(spark, d))
    # a closing observation moves the watermark past the last real day
    last = hours.agg((F.max("ts") + F.expr("interval 9 days")).alias("ts"), (F.max("arrival") + 1).alias("arrival"))
    hours = hours.unionByName(last.withColumn("site_id", F.lit(-1).cast("long")), allowMissingColumns=True)
    days = L.daily_stream(_in_turn(hours, folder, L.day_end(F.col("ts")), _ONE_DAY), _ONE_DAY)
    L.run_available(days, f"{folder}/out", f"{folder}/ckpt")
    return rounded(spark.read.parquet(f"{folder}/out").filter(F.col("site_id") >= 0), 6)


@query("r1_late_hours", "R1", sql("hourly", _ARRIVED.lstrip() + "SELECT site_id, CAST(ts AS VARCHAR) AS ts, CAST(passed AS VARCHAR) AS watermark, round(pm10, 6) AS pm10 FROM l WHERE late"))
def late_hours(spark: SparkSession, d: str) -> DataFrame:
    """The hours that came after the watermark had passed their day, with the watermark that they met."""
    folder = scratch(spark)
    _in_turn(_arrivals(X.hourly(spark, d)), folder, L.day_end(F.col("ts")), _ONE_DAY)
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("ts", "watermark")]
    return rounded(spark.read.parquet(f"{folder}/late").select("site_id", *shown, "pm10"), 6)


@query("r2_deduplicated_stream", "R2", sql("hourly", _DAYS))
def deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return _run_daily(spark, d, twice=True)


@query("r3_site_state_stream", "R3", sql("rollup sites clim thresholds", """, d AS (SELECT r.site_id, r.date, r.precip_mm, f, x.pm10_max, threshold, row_number() OVER (PARTITION BY r.site_id ORDER BY r.date)-1 AS i
      FROM (SELECT rollup.site_id, date, precip_mm, {f} AS f FROM rollup JOIN sites s ON s.site_id=rollup.site_id JOIN clim USING (climate)) r JOIN daily x ON x.site_id=r.site_id AND x.date=r.date JOIN thresholds t ON t.site_id=r.site_id),
    fold AS (SELECT DISTINCT site_id, -1::BIGINT AS i, 0.0::DOUBLE AS e FROM d UNION ALL
      SELECT d.site_id, d.i, CASE WHEN d.precip_mm >= 5 THEN least(400, fold.e+d.f)*0.15::DOUBLE ELSE least(400, fold.e+d.f) END FROM fold JOIN d ON d.site_id=fold.site_id AND d.i=fold.i+1)
    SELECT d.site_id, d.date, round(e+1e-9,4) AS exposure, CAST(least(coalesce(d.i-max(CASE WHEN precip_mm >= 1 THEN d.i END) OVER (PARTITION BY d.site_id ORDER BY d.i ROWS UNBOUNDED PRECEDING),120),120) AS INTEGER) AS days_since_rain,
      pm10_max >= threshold AS storm_alert FROM d JOIN fold ON fold.site_id=d.site_id AND fold.i=d.i""".replace(
          "{f}", sql_dust_factor()), recursive=True))
def site_state(spark: SparkSession, d: str) -> DataFrame:
    """Days arrive up to two days late and out of order, over several triggers; the state still follows the calendar."""
    folder = scratch(spark)
    outlook = SC.dust_outlook(X.rollup(spark, d), X.sites(spark, d)).select("site_id", "date", "dust_factor", "precip_mm")
    limits = with_threshold(X.daily(spark, d), X.VAL_START).select("site_id", "date", "pm10_max", "threshold")
    days = outlook.join(limits, ["site_id", "date"]).withColumn("ts", F.col("date").cast("timestamp"))
    # a file holds what arrives in 250 days; a day's own delay is nought to two days
    delay = F.pmod(F.xxhash64("site_id", "date"), F.lit(3)).cast("int")
    days = days.withColumn("arrival", F.floor(F.unix_date(F.date_add("date", delay)) / 250))
    closing = days.groupBy("site_id").agg(F.lit(None).cast("date").alias("date")).join(F.broadcast(days.agg(
        (F.max("ts") + F.expr("interval 9 days")).alias("ts"), (F.max("arrival") + 1).alias("arrival"))))
    zero = {c: F.lit(0.0) for c in ("dust_factor", "precip_mm", "pm10_max", "threshold")}
    rows = days.unionByName(closing.withColumns(zero)).drop("date")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, L.ROCKSDB)
    try:
        stream = _in_turn(rows, folder, F.col("ts"), "3 days")
        L.run_available(L.site_state_stream(stream, "3 days"), f"{folder}/out", f"{folder}/ckpt")
    finally:
        spark.conf.set(key, before)
    out = spark.read.parquet(f"{folder}/out")
    return out.withColumn("exposure", F.round(F.col("exposure") + 1e-9, 4))
