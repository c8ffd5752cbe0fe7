"""2.P regressions."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.j_weather import _STORM, storms
from quarterhour.catalog.n_what_if import _P6
from quarterhour.catalog.sqlparts import ols, slope
from quarterhour.operators import regress as rg


@query("p1_block_sensitivity", "state block:i intercept:f beta_temperature:f beta_humidity:f beta_precipitation:f r2:f n:i",
       ols("v_frame", "load", ["temperature", "humidity", "precipitation"], "state, block", 10))
def _(v):
    return rg.ols(v.frame, "load", ["temperature", "humidity", "precipitation"], ["state", "block"], 10)


@query("p1_two_feature_ols", "state intercept:f beta_temperature:f beta_wind_speed_10m:f r2:f n:i", ols("v_frame", "load", ["temperature", "wind_speed_10m"], "state", 10))
def _(v):
    return rg.ols(v.frame, "load", ["temperature", "wind_speed_10m"], ["state"], 10)


_BINS = """l AS (SELECT state, min(temperature) AS lo, max(temperature) AS hi FROM v_frame GROUP BY state),
    tb AS (SELECT f.state, least(25, CAST(floor((temperature - lo) / nullif((hi - lo) / 25, 0)) AS BIGINT) + 1) AS bin, avg(load) AS load_mean, stddev_samp(load) AS load_std, count(*) AS n, avg(temperature) AS temp_mean FROM v_frame f JOIN l USING (state) WHERE temperature IS NOT NULL GROUP BY ALL)"""


@query("p2_temperature_bins", "state bin:i load_mean:f load_std:f n:i temp_mean:f", f"WITH {_BINS} SELECT * FROM tb")
def _(v):
    return rg.temperature_bins(v.frame)


@query("p2_temperature_curve", "state cooling_slope:f heating_slope:f optimum_temp:f optimum_load:f", f"""
    WITH {_BINS}, d AS (SELECT *, CASE WHEN temperature > 22 THEN temperature - 22 END AS c, CASE WHEN temperature < 15 THEN 15 - temperature END AS h FROM v_frame),
    s AS (SELECT state, {slope('load', 'c')} AS cooling_slope, {slope('load', 'h')} AS heating_slope FROM d GROUP BY state), o AS (SELECT state, arg_min(temp_mean, (load_mean, bin)) AS optimum_temp, min(load_mean) AS optimum_load FROM tb GROUP BY state)
    SELECT * FROM s JOIN o USING (state)""")
def _(v):
    return rg.temperature_curve(v.frame)


@query("p3_day_sensitivity", "state cooling_sensitivity:f heating_sensitivity:f humidity_sensitivity:f temperature_sensitivity:f humidity_amplification:f n_days:i", f"""
    WITH d AS (SELECT state, date, avg(load) AS y, avg(temperature) AS tq, avg(humidity) AS hum, greatest(avg(temperature) - 24, 0) AS cdd, greatest(18 - avg(temperature), 0) AS hdd FROM v_frame GROUP BY state, date),
    a AS ({ols('d', 'y', ['cdd', 'hdd', 'hum'], 'state', 5)}), b AS ({ols('d', 'y', ['cdd', 'hum'], 'state', 5)}), c AS ({ols('d', 'y', ['hdd', 'hum'], 'state', 5)}),
    h AS (SELECT state, {slope('y', 'hum')} AS o3, {slope('y', 'tq')} AS ts, median(hum) AS mh, count(*) AS n FROM d GROUP BY state),
    q AS (SELECT d.state, {slope('y', 'CASE WHEN hum > mh THEN cdd END')} AS sh, {slope('y', 'CASE WHEN hum <= mh THEN cdd END')} AS sd, count(*) FILTER (WHERE hum > mh) AS nh, count(*) FILTER (WHERE hum <= mh) AS nd FROM d JOIN h USING (state) GROUP BY d.state)
    SELECT h.state, greatest(coalesce(a.beta_cdd, b.beta_cdd, 0), 0) AS cooling_sensitivity, greatest(coalesce(a.beta_hdd, CASE WHEN b.beta_cdd IS NULL THEN c.beta_hdd END, 0), 0) AS heating_sensitivity,
      coalesce(a.beta_hum, b.beta_hum, c.beta_hum, o3, 0) AS humidity_sensitivity, ts AS temperature_sensitivity, CASE WHEN least(nh, nd) >= 4 AND sd > 1e-6 AND sh > 0 THEN sh / sd END AS humidity_amplification, h.n AS n_days
    FROM h LEFT JOIN a USING (state) LEFT JOIN b USING (state) LEFT JOIN c USING (state) JOIN q USING (state)""")
def _(v):
    return rg.day_sensitivity(v.frame_once)


@query("p4_driver_ratios", "state block:i block_mean:f weekend_weight:f holiday_weight:f", """
    SELECT state, block, avg(load) AS block_mean, coalesce((avg(load) FILTER (WHERE is_weekend = 1) - avg(load) FILTER (WHERE is_weekend = 0)) / avg(load) FILTER (WHERE is_weekend = 0), 0) AS weekend_weight,
      coalesce((avg(load) FILTER (WHERE is_holiday = 1) - avg(load) FILTER (WHERE is_holiday = 0)) / avg(load) FILTER (WHERE is_holiday = 0), 0) AS holiday_weight FROM v_frame GROUP BY state, block""")
def _(v):
    return rg.driver_ratios(v.frame)


@query("p4_driver_weights", "state block:i temperature_weight:f humidity_weight:f precipitation_weight:f wind_speed_10m_weight:f weekend_weight:f holiday_weight:f n:f")
def _(v):
    return rg.driver_weights(v.frame)


@query("p5_elastic_net_weights", "state block:i temperature_weight:f humidity_weight:f precipitation_weight:f temperature_weight_smooth:f confidence:f alpha:f n:f")
def _(v):
    return rg.elastic_net_weights(v.frame, ["temperature", "humidity", "precipitation"])


@query("p6_asymmetric_temperature", "state block:i direction median_slope:f n:i coefficient:f", f"WITH {_P6} SELECT * FROM p6")
def _(v):
    return rg.temperature_steps(v.frame)


_CLEAR = f"{_STORM}, cl AS (SELECT f.*, year(date) AS year FROM v_frame f JOIN sd USING (state, date) WHERE NOT storm)"


@query("p7_block_year_regressions", "state block:i year:i intercept:f beta_temperature:f beta_humidity:f beta_wind_speed_10m:f r2:f n:f")
def _(v):
    return rg.block_year_ols(v.frame, ["temperature", "humidity", "wind_speed_10m"], storms(v), min_rows=6)


@query("p7_yearly_drift", "state year:i avg_temperature:f avg_humidity:f blocks:i", f"""
    WITH {_CLEAR} SELECT state, year, avg(beta_temperature) AS avg_temperature, avg(beta_humidity) AS avg_humidity, count(*) AS blocks
    FROM ({ols("cl", "load", ["temperature", "humidity"], "state, block, year", 6)}) GROUP BY state, year""")
def _(v):
    return rg.yearly_drift(rg.block_year_ols(v.frame, ["temperature", "humidity"], storms(v), min_rows=6), ["temperature", "humidity"])


@query("p8_residual_trend", "state date slope:f intercept:f n:i", f"""
    SELECT state, date, {slope('actual - forecast', 'block')} AS slope, avg(actual - forecast) - {slope('actual - forecast', 'block')} * avg(block) AS intercept, count(*) AS n FROM v_pair GROUP BY state, date""")
def _(v):
    return rg.residual_trend(v.pair.withColumn("residual", F.col("actual") - F.col("forecast")))
