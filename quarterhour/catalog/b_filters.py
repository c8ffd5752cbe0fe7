"""2.B projections, filters and predicates."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import spearman_wide
from quarterhour.functions.numbers import over_zero
from quarterhour.operators import clean, features, kpis, select
from quarterhour.plans import views as view_registry
from quarterhour.sources import normalise


@query("b1_structural_filter", "state date block:i load:f", """
    SELECT state, date, block, load FROM v_load WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'
      AND isodow(date) - 1 IN (0, 2, 5, 6) AND month(date) = 1 AND block BETWEEN 20 AND 70""")
def _(v):
    return select.structural_filter(v.load, "2024-01-03", "2024-01-26", weekdays=(0, 2, 5, 6), months=(1,), blocks=(20, 70))


@query("b1_weekend_only", "state date block:i load:f", """
    SELECT state, date, block, load FROM v_load WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-26' AND isodow(date) >= 6""")
def _(v):
    return select.structural_filter(v.load, "2024-01-03", "2024-01-26", weekend_only=True)


@query("b2_region_known", "state date block:i load:f", "SELECT * FROM v_load WHERE state = 'R1'")
def _(v):
    return select.region_or_all(v.load, " r1")


@query("b2_region_unknown", "state date block:i load:f", "SELECT * FROM v_load")
def _(v):
    return select.region_or_all(v.load, "atlantis")


@query("b3_resample_hourly", "state ts load:f temperature:f", """
    SELECT state, date_trunc('hour', CAST(date AS TIMESTAMP) + to_minutes((block - 1) * 15)) AS ts, avg(load) AS load, avg(temperature) AS temperature
    FROM v_frame GROUP BY ALL""")
def _(v):
    return select.resample(v.frame, "hourly", ["load", "temperature"])


@query("b3_resample_daily", "state ts load:f", "SELECT state, CAST(date AS TIMESTAMP) AS ts, avg(load) AS load FROM v_load GROUP BY ALL")
def _(v):
    return select.resample(v.load, "daily", ["load"])


@query("b4_latest_robust_date", "state robust_date last_date robust_days:i resolved", """
    WITH d AS (SELECT state, date, count(DISTINCT block) AS n, avg(load) AS m FROM v_load GROUP BY ALL)
    SELECT state, max(date) FILTER (WHERE n >= 90 AND m > 100) AS robust_date, max(date) AS last_date, count(*) FILTER (WHERE n >= 90 AND m > 100) AS robust_days,
      coalesce(max(date) FILTER (WHERE n >= 90 AND m > 100), max(date)) AS resolved FROM d GROUP BY state""")
def _(v):
    return select.latest_robust_date(v.load, min_blocks=90)


@query("b4_resolve_date", "state date exact", """
    SELECT state, coalesce(max(CASE WHEN date = DATE '1997-03-14' THEN date END), max(date)) AS date,
      max(CASE WHEN date = DATE '1997-03-14' THEN date END) IS NOT NULL AS exact FROM v_daily GROUP BY state""")
def _(v):
    return select.resolve_date(v.daily, "1997-03-14")


@query("b5_valid_prefix", "state date valid_blocks:i", """
    SELECT g.state, g.date, coalesce(min(CASE WHEN coalesce(l.load, 0) < 5 THEN g.block END), 97) - 1 AS valid_blocks
    FROM (SELECT DISTINCT state, date FROM v_load) d JOIN v_grid g USING (state, date) LEFT JOIN v_load l USING (state, date, block) GROUP BY ALL""")
def _(v):
    return select.valid_prefix(v.load, floor=5.0)


@query("b6_selection_mask", "state date block:i mask:f soft_mask:f", """
    WITH m AS (SELECT state, date, block, CASE WHEN block BETWEEN 30 AND 60 THEN 1.0::DOUBLE ELSE 0 END AS mask FROM v_grid),
    n AS (SELECT *, coalesce(lag(mask) OVER w, mask) AS l, coalesce(lead(mask) OVER w, mask) AS r FROM m WINDOW w AS (PARTITION BY state, date ORDER BY block))
    SELECT state, date, block, mask, CASE WHEN (mask = 0 AND (l = 1 OR r = 1)) OR (mask = 1 AND (l = 0 OR r = 0)) THEN 0.5 ELSE mask END AS soft_mask FROM n""")
def _(v):
    return select.soft_edges(v.grid.withColumn("mask", select.selection_mask("range", 60, 30)))


@query("b7_placeholder_hygiene", "state date block:i load:f", "SELECT state, date, block, CASE WHEN load > 20 THEN load END AS load FROM v_load")
def _(v):
    return v.load.withColumn("load", over_zero("load", 20.0))


_FF = """coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY state ORDER BY date, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  first_value(x IGNORE NULLS) OVER (PARTITION BY state ORDER BY date, block ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("b8_bounds_const", "state date block:i load:f", f"""
    SELECT state, date, block, {_FF} AS load FROM (SELECT *, CASE WHEN load BETWEEN 10 AND 300 THEN load END AS x FROM v_load)""")
def _(v):
    return clean.bounded(v.load, "load", 10, 300)


@query("b8_bounds_quantile", "state date block:i load:f", f"""
    WITH q AS (SELECT state, quantile_cont(load, 0.05) AS lo, quantile_cont(load, 0.95) AS hi FROM v_load GROUP BY state)
    SELECT state, date, block, {_FF} AS load FROM (SELECT l.*, CASE WHEN load BETWEEN lo AND hi THEN load END AS x FROM v_load l JOIN q USING (state))""")
def _(v):
    return clean.bounded(v.load, "load", 0.05, 0.95, method="quantile")


@query("b9_one_based_blocks", "state date block:i load:f", """
    SELECT state, date, CAST(CASE WHEN state = 'R1' THEN block ELSE block END AS INTEGER) AS block, load FROM v_load""")
def _(v):
    zero_based = F.when(F.col("state") == "R1", F.col("block") - 1).otherwise(F.col("block"))
    return normalise.one_based_blocks(v.load.withColumn("block", zero_based))


@query("b10_fixed_bins", "state date block:i time_of_day rain_intensity temp_class hum_class", """
    SELECT state, date, block, CASE WHEN hour <= 6 THEN 'Night' WHEN hour <= 12 THEN 'Morning' WHEN hour <= 18 THEN 'Afternoon' ELSE 'Evening' END AS time_of_day,
      CASE WHEN precipitation <= 0.01 THEN 'None' WHEN precipitation <= 1 THEN 'Light' WHEN precipitation <= 5 THEN 'Moderate' WHEN precipitation <= 20 THEN 'Heavy'
        WHEN precipitation <= 1000 THEN 'Storm' END AS rain_intensity,
      CASE WHEN temperature <= -10 THEN NULL WHEN temperature <= 15 THEN 'Cool' WHEN temperature <= 25 THEN 'Mild' WHEN temperature <= 35 THEN 'Hot' WHEN temperature <= 100 THEN 'Extreme' END AS temp_class,
      CASE WHEN humidity <= -1 THEN NULL WHEN humidity <= 40 THEN 'Dry' WHEN humidity <= 70 THEN 'Normal' WHEN humidity <= 100 THEN 'Humid' END AS hum_class FROM v_frame""")
def _(v):
    tc, hc = select.climate_class("temperature", "humidity")
    return v.frame.select("state", "date", "block", features.time_of_day("hour").alias("time_of_day"), features.rain_class("precipitation").alias("rain_intensity"),
                          tc.alias("temp_class"), hc.alias("hum_class"))


@query("b11_equal_width_bins", "state bin:i n:i mean_temp:f", """
    WITH l AS (SELECT state, min(temperature) AS lo, max(temperature) AS hi FROM v_frame GROUP BY state)
    SELECT state, bin, count(*) AS n, avg(temperature) AS mean_temp FROM (
      SELECT f.state, temperature, least(25, CAST(floor((temperature - lo) / nullif((hi - lo) / 25, 0)) AS BIGINT) + 1) AS bin FROM v_frame f JOIN l USING (state) WHERE temperature IS NOT NULL)
    GROUP BY state, bin""")
def _(v):
    return (select.equal_width_bins(v.frame, "temperature", 25).where("bin is not null").groupBy("state", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("temperature").alias("mean_temp")))


@query("b12_tertiles", "state date block:i tertile:i", """
    SELECT state, date, block, ntile(3) OVER (PARTITION BY state ORDER BY temperature, date, block) AS tertile FROM v_frame WHERE temperature IS NOT NULL""")
def _(v):
    return select.tertiles(v.frame, "temperature")


@query("b13_standard_and_hourly_kpis", "state hour:i average:f peak:f volatility:f points:i", """
    SELECT state, hour, avg(load) AS average, max(load) AS peak, stddev_samp(load) AS volatility, count(load) AS points FROM v_cal GROUP BY GROUPING SETS ((state), (state, hour))""")
def _(v):
    return kpis.standard_and_hourly(v.cal)


@query("b14_view_dispatch", "state view metric value:f", f"""
    WITH s AS ({spearman_wide('v_frame', 'state', {'t': ('load', 'temperature'), 'h': ('load', 'humidity')})}),
    k AS (SELECT state, avg(load) AS average, max(load) AS peak, stddev_samp(load) AS volatility, CAST(count(load) AS DOUBLE) AS points FROM v_frame GROUP BY state)
    SELECT state, 'standard_kpis' AS view, metric, value FROM (UNPIVOT k ON average, peak, volatility, points INTO NAME metric VALUE value)
    UNION ALL SELECT state, 'weather_correlation', 'temperature', t FROM s
    UNION ALL SELECT state, 'weather_correlation', 'humidity', h FROM s""")
def _(v):
    return view_registry.dispatch(v.frame, ["standard_kpis", "weather_correlation"])


@query("b15_complete_days", "state date valid_blocks:i", """
    SELECT state, date, count(*) FILTER (WHERE load > 5) AS valid_blocks FROM v_load GROUP BY ALL HAVING count(*) FILTER (WHERE load > 5) >= 60""")
def _(v):
    return select.complete_days(v.load, min_blocks=60, floor=5.0)


@query("b16_alias_columns", "state max_wind:f", "SELECT state, max(wind_speed_10m) AS max_wind FROM v_wmean GROUP BY state")
def _(v):
    w = select.first_present(v.wmean, ("wind_speed", "wind_speed_10m", "windspeed_10m"))
    return v.wmean.groupBy("state").agg(F.max(w).alias("max_wind"))
