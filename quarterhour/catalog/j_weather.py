"""2.J weather physics, spatial aggregation and events."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.functions import physics
from quarterhour.functions.stats import weighted_avg
from quarterhour.operators import weather as wx
from quarterhour.operators.merge import with_weather
from quarterhour.operators.regress import location_weights

_WB = ("CASE WHEN humidity BETWEEN 5 AND 99 AND temperature BETWEEN -20 AND 50 THEN temperature * atan(0.151977::DOUBLE * sqrt(humidity + 8.313659::DOUBLE)) + atan(temperature + humidity) - atan(humidity - 1.676331::DOUBLE) "
       "+ 0.00391838::DOUBLE * pow(humidity, 1.5::DOUBLE) * atan(0.023101::DOUBLE * humidity) - 4.686035::DOUBLE END")
_G = "(ln(least(humidity, 100) / 100) + 17.625::DOUBLE * temperature / (243.04::DOUBLE + temperature))"
_DEW = f"CASE WHEN humidity > 0 THEN 243.04::DOUBLE * {_G} / (17.625::DOUBLE - {_G}) END"

_DIST = f"""s0 AS (SELECT state, (min(date) - DATE '1970-01-01') * 96 + 1 AS t0 FROM v_wloc GROUP BY state),
    c0 AS (SELECT w.*, t0, coalesce(weight, 0) AS wt, CAST(date - DATE '1970-01-01' AS BIGINT) * 96 + block AS t, greatest(temperature - 24, 0) AS cd, {_WB} AS wb, {_DEW} AS dew FROM v_wloc w JOIN s0 USING (state) LEFT JOIN v_dw USING (location)),
    c1 AS (SELECT *, sum(cd) OVER a AS s6, count(cd) OVER a AS n6, sum(cd) OVER b AS s24, count(cd) OVER b AS n24 FROM c0
      WINDOW a AS (PARTITION BY state, location ORDER BY t RANGE BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY state, location ORDER BY t RANGE BETWEEN 95 PRECEDING AND CURRENT ROW)),
    c2 AS (SELECT *, CASE WHEN t - t0 >= 23 AND n6 >= 0.3::DOUBLE * 24 THEN s6 * (24.0::DOUBLE / n6) * 0.25 END AS cdh6, CASE WHEN t - t0 >= 95 AND n24 >= 0.3::DOUBLE * 96 THEN s24 * (96.0::DOUBLE / n24) * 0.25 END AS cdh24 FROM c1)"""


def wm(c):
    return f"sum(wt * {c}) / nullif(sum(wt) FILTER (WHERE {c} IS NOT NULL), 0)"


_SW = ["temp_mean", "hum_mean", "temp_wmean", "hum_wmean", "wb_wmean", "dew_wmean", "precip_wmean", "cloud_wmean", "wind_wmean", "rad_wmean", "temp_p90", "temp_max", "temp_std", "hot_share", "wb_p90", "wb_max", "wb_hot_share",
       "cdh6_wmean", "cdh24_wmean", "cdh24_p90", "night_min_temp", "prev_day_temp_wmax", "wx_weight_coverage"]


@query("j1_state_weather_features", "state date block:i " + " ".join(f"{c}:f" for c in _SW) + " hot_day_streak:i wx_district_count:i", f"""
    WITH {_DIST}, g AS (SELECT state, date, block, avg(temperature) AS temp_mean, avg(humidity) AS hum_mean, {wm('temperature')} AS temp_wmean, {wm('humidity')} AS hum_wmean, {wm('wb')} AS wb_wmean, {wm('dew')} AS dew_wmean,
        {wm('precipitation')} AS precip_wmean, {wm('cloud_cover')} AS cloud_wmean, {wm('wind_speed_10m')} AS wind_wmean, {wm('direct_radiation')} AS rad_wmean, quantile_cont(temperature, 0.9) AS temp_p90, max(temperature) AS temp_max,
        stddev_pop(temperature) AS temp_std, sum(wt) FILTER (WHERE temperature >= 35) AS hs, sum(wt) FILTER (WHERE temperature IS NOT NULL) AS present, quantile_cont(wb, 0.9) AS wb_p90, max(wb) AS wb_max,
        sum(wt) FILTER (WHERE wb >= 26) AS whs, sum(wt) FILTER (WHERE wb IS NOT NULL) AS wpresent, {wm('cdh6')} AS cdh6_wmean, {wm('cdh24')} AS cdh24_wmean, quantile_cont(cdh24, 0.9) AS cdh24_p90, count(temperature) AS wx_district_count FROM c2 GROUP BY state, date, block),
    d AS (SELECT state, date, min(temp_wmean) FILTER (WHERE block <= 24) AS night_min_temp, max(temp_wmean) AS dmax FROM g GROUP BY state, date),
    r AS (SELECT *, sum(CASE WHEN dmax >= 38 THEN 0 ELSE 1 END) OVER (PARTITION BY state ORDER BY date) AS grp FROM d),
    k AS (SELECT *, sum(CASE WHEN dmax >= 38 THEN 1 ELSE 0 END) OVER (PARTITION BY state, grp ORDER BY date) AS hot_day_streak, max(dmax) OVER (PARTITION BY state ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev_day_temp_wmax FROM r)
    SELECT g.*, coalesce(hs, 0) / nullif(present, 0) AS hot_share, CASE WHEN wpresent > 0 THEN coalesce(whs, 0) / wpresent END AS wb_hot_share, present / 28 AS wx_weight_coverage, night_min_temp, hot_day_streak, prev_day_temp_wmax FROM g JOIN k USING (state, date)""")
def _(v):
    return wx.state_weather(v.wloc, v.dw, min_fraction=0.3)


@query("j2_weighted_mean_and_share", "state date block:i wmean:f share_hot:f", f"""
    SELECT state, date, block, {wm('temperature').replace('wt', 'weight')} AS wmean, coalesce(sum(weight) FILTER (WHERE temperature >= 30), 0) / sum(weight) FILTER (WHERE temperature IS NOT NULL) AS share_hot FROM v_wloc JOIN v_dw USING (location) GROUP BY ALL""")
def _(v):
    return v.wloc.join(v.dw, "location").groupBy("state", "date", "block").agg(
        weighted_avg("temperature", "weight").alias("wmean"), wx.share_at_or_above(F.col("temperature"), F.col("weight"), 30.0).alias("share_hot"))


@query("j3_wet_bulb", "state location date block:i wet_bulb:f", f"SELECT state, location, date, block, {_WB} AS wet_bulb FROM v_wloc")
def _(v):
    return v.wloc.withColumn("wet_bulb", physics.wet_bulb("temperature", "humidity"))


@query("j4_dew_point", "state location date block:i dew_point:f", f"SELECT state, location, date, block, {_DEW} AS dew_point FROM v_wloc")
def _(v):
    return v.wloc.withColumn("dew_point", physics.dew_point("temperature", "humidity"))


@query("j5_cooling_degree", "state location date block:i cd:f", "SELECT state, location, date, block, greatest(temperature - 24, 0) AS cd FROM v_wloc")
def _(v):
    return v.wloc.withColumn("cd", physics.degrees_above("temperature", 24.0))


@query("j6_location_weighted_weather", "state date block:i temperature:f humidity:f wind_speed_10m:f locations:i", """
    SELECT state, date, block, sum(weight * coalesce(temperature, 0)) / sum(weight) AS temperature, sum(weight * coalesce(humidity, 0)) / sum(weight) AS humidity, sum(weight * coalesce(wind_speed_10m, 0)) / sum(weight) AS wind_speed_10m,
      count(*) AS locations FROM v_wloc JOIN v_dw USING (location) GROUP BY ALL""")
def _(v):
    return wx.weighted_by_location(v.wloc, v.dw, ("temperature", "humidity", "wind_speed_10m"))


_CORR = """x AS (SELECT w.*, month(date) AS month, l.load FROM v_wloc w JOIN v_load l USING (state, date, block)),
    r AS (SELECT state, month, location, CASE WHEN stddev_pop({f}) > 0 AND stddev_pop(load) > 0 THEN covar_pop({f}, load) / (stddev_pop({f}) * stddev_pop(load)) END AS r FROM x GROUP BY ALL)"""


def located(v):
    return with_weather(v.wloc, v.load, "inner").withColumn("month", F.month("date"))


@query("j7_correlation_softmax_weights", "state month:i location r:f weight:f", f"""
    WITH {_CORR.format(f='temperature')}, w AS (SELECT *, exp(least(greatest(coalesce(r, 0), -3), 3)) * 0.95::DOUBLE + 0.05::DOUBLE / count(*) OVER (PARTITION BY state, month) AS raw FROM r)
    SELECT state, month, location, r, raw / sum(raw) OVER (PARTITION BY state, month) AS weight FROM w""")
def _(v):
    return wx.correlation_weights(located(v), "temperature")


@query("j7_correlation_weighted_weather", "state date block:i temperature_cw:f", f"""
    WITH {_CORR.format(f='temperature')}, w AS (SELECT *, exp(least(greatest(coalesce(r, 0), -3), 3)) * 0.95::DOUBLE + 0.05::DOUBLE / count(*) OVER (PARTITION BY state, month) AS raw FROM r)
    SELECT state, date, block, sum(raw * temperature) / sum(raw) AS temperature_cw FROM x JOIN w USING (state, month, location) GROUP BY ALL""")
def _(v):
    return wx.correlation_weighted(located(v), ["temperature"])


def _j8(method, raw):
    sql = f"""WITH {_CORR.format(f='humidity')}, n AS (SELECT *, -coalesce(r, 0) AS s FROM r), w AS (SELECT *, {raw} AS raw FROM n)
      SELECT state, month, location, CASE WHEN sum(raw) OVER (PARTITION BY state, month) > 0 THEN raw / sum(raw) OVER (PARTITION BY state, month) ELSE 1.0::DOUBLE / count(*) OVER (PARTITION BY state, month) END AS weight FROM w"""

    @query(f"j8_weights_{method}", "state month:i location weight:f", sql)
    def _(v):
        return wx.correlation_weights(located(v), "humidity", method, sign=-1)


for _m, _raw in (("mean", "CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END"), ("abs", "abs(s)"), ("clip", "greatest(s, 0)"), ("hybrid", "CASE WHEN s < 0 THEN abs(s) * 0.2::DOUBLE ELSE s END")):
    _j8(_m, _raw)


@query("j9_learned_location_weights", "state location r2:f weight:f")
def _(v):
    return location_weights(located(v), ["temperature", "humidity", "cloud_cover", "wind_speed_10m"])


_EV = """f AS (SELECT state, date, block, coalesce(temperature, 25) AS t, coalesce(precipitation, 0) AS p, coalesce(wind_speed_10m, 0) AS w, coalesce(cloud_cover, 0) AS c, coalesce(direct_radiation, 0) AS r, coalesce(humidity, 50) AS h FROM v_frame),
    l AS (SELECT *, coalesce(c - lag(c) OVER x, 0) AS dc, coalesce(h - lag(h) OVER x, 0) AS dh, coalesce(CASE WHEN lag(r) OVER x > 10 THEN (lag(r) OVER x - r) / lag(r) OVER x * 100 END, 0) AS dr, row_number() OVER x AS rn, count(*) OVER (PARTITION BY state, date) AS n
      FROM f WINDOW x AS (PARTITION BY state, date ORDER BY block)),
    u AS (SELECT *, max(w) OVER y >= 25 AND max(dc) OVER y >= 10 AND max(dr) OVER y >= 20 AND max(dh) OVER y >= 5 AND rn <= n - 8 AS dust FROM l WINDOW y AS (PARTITION BY state, date ORDER BY block ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    a AS (SELECT state, date, avg(p) AS rain_avg, max(p) AS rain_peak, max(w) AS wind_max, max(t) AS temp_max, min(t) AS temp_min, bool_or(dust) AS dust_storm, min(rn) FILTER (WHERE dust) AS dust_start, count(*) FILTER (WHERE p > 1) AS rain_blocks,
      count(*) FILTER (WHERE w >= 25) AS wind_blocks, count(*) FILTER (WHERE t >= 42) AS heat_blocks, count(*) FILTER (WHERE t <= 14) AS cold_blocks FROM u GROUP BY state, date),
    e AS (SELECT *, rain_avg >= 0.3 AS rain, rain_avg >= 0.8 OR rain_peak >= 15 AS heavy_rain, wind_max >= 25 AS wind, wind_max >= 40 AS gusty, temp_max >= 42 AS heat, temp_min <= 14 AS cold, temp_min <= 12 AS severe_cold FROM a)"""
_LIM = wx.EventLimits(rain_avg=0.3, heavy_rain_avg=0.8, cold=14.0, severe_cold=12.0, dust_cloud_rise=10.0, dust_radiation_drop=20.0, dust_humidity_rise=5.0)


@query("j10_weather_events", "state date rain heavy_rain wind gusty heat cold severe_cold dust_storm dust_start:i rain_blocks:i wind_blocks:i cold_blocks:i impact_mw:f severity description clamp_sigma:f decay:f", f"""
    WITH {_EV}, s AS (SELECT *, CASE WHEN rain THEN -80 * rain_avg ELSE 0 END + CASE WHEN wind THEN -5 * (wind_max - 25) ELSE 0 END + CASE WHEN heat THEN 60 * (temp_max - 42) ELSE 0 END + CASE WHEN cold THEN -40 * (14 - temp_min) ELSE 0 END AS impact_mw,
      CASE WHEN heavy_rain AND gusty THEN 'CRITICAL' WHEN heavy_rain OR gusty OR heat OR severe_cold OR dust_storm THEN 'HIGH' WHEN rain OR wind OR cold THEN 'MEDIUM' ELSE 'NONE' END AS severity,
      concat_ws(' + ', CASE WHEN heavy_rain THEN 'Heavy rain' WHEN rain THEN 'Rain' END, CASE WHEN gusty THEN 'Gusty winds' WHEN wind THEN 'Strong winds' END, CASE WHEN heat THEN 'Extreme heat' END, CASE WHEN severe_cold THEN 'Severe cold' WHEN cold THEN 'Cold' END,
        CASE WHEN dust_storm THEN 'Dust storm' END) AS txt FROM e)
    SELECT *, CASE WHEN txt = '' THEN 'No anomaly' ELSE txt END AS description, CASE severity WHEN 'NONE' THEN 2.5 WHEN 'MEDIUM' THEN 3 WHEN 'HIGH' THEN 4 ELSE 5 END AS clamp_sigma, CASE severity WHEN 'NONE' THEN 0.997 WHEN 'MEDIUM' THEN 0.998 ELSE 0.999 END AS decay FROM s""")
def _(v):
    return wx.day_events(v.frame, _LIM)


_REG = """rg AS (SELECT state, date, CASE WHEN p > 1 OR px > 5 THEN 'RAINY' WHEN tx > 42 AND h < 35 AND w > 25 THEN 'DUSTY' WHEN tx > 42 OR (tx > 40 AND h < 45) THEN 'PRE_MONSOON_HOT' WHEN c > 75 AND w > 25 THEN 'DUSTY' ELSE 'NORMAL' END AS regime
      FROM (SELECT state, date, avg(precipitation) AS p, max(precipitation) AS px, max(temperature) AS tx, avg(humidity) AS h, max(wind_speed_10m) AS w, avg(cloud_cover) AS c FROM v_frame GROUP BY ALL))"""


@query("j11_weather_regime", "state date regime", f"WITH {_REG} SELECT * FROM rg")
def _(v):
    return wx.weather_regime(v.frame)


@query("j12_heat_index", "state date block:i hi:f simple:f", """
    SELECT state, date, block, -8.78::DOUBLE + 1.611::DOUBLE * t + 2.338::DOUBLE * h - 0.146::DOUBLE * t * h - 0.0123::DOUBLE * t * t - 0.0164::DOUBLE * h * h + 0.00221::DOUBLE * t * t * h + 0.000725::DOUBLE * t * h * h - 0.00000358::DOUBLE * t * t * h * h AS hi,
      0.5::DOUBLE * (t + 61 + (t - 68) * 1.2::DOUBLE + h * 0.094::DOUBLE) AS simple FROM (SELECT state, date, block, temperature AS t, humidity AS h FROM v_frame)""")
def _(v):
    from quarterhour.operators.features import heat_index
    return v.frame.withColumn("hi", wx.heat_index_polynomial("temperature", "humidity")).withColumn("simple", heat_index("temperature", "humidity"))


_STORM = "sd AS (SELECT state, date, coalesce(sum(precipitation) > 15 OR max(wind_speed_10m) > 85, false) AS storm FROM v_frame GROUP BY state, date)"
_SPROF = "sp AS (SELECT state, block, avg(load) FILTER (WHERE storm) AS storm_load, avg(load) FILTER (WHERE NOT storm) AS clear_load FROM v_frame JOIN sd USING (state, date) GROUP BY state, block)"


def storms(v):
    return wx.storm_days(v.frame, 15.0, 85.0)


@query("j13_storm_profile", "state block:i storm_load:f clear_load:f suppression:f", f"WITH {_STORM}, {_SPROF} SELECT *, clear_load - storm_load AS suppression FROM sp")
def _(v):
    return wx.storm_profile(v.frame, storms(v))


@query("j13_storm_events", "state date onset_block:i max_suppression:f duration_blocks:i recovery_blocks:i", f"""
    WITH {_STORM}, {_SPROF}, j AS (SELECT f.state, f.date, f.block, clear_load - load AS d FROM v_frame f JOIN sd USING (state, date) JOIN sp USING (state, block) WHERE storm)
    SELECT state, date, min(block) FILTER (WHERE d > 50) AS onset_block, max(d) AS max_suppression, count(*) FILTER (WHERE d > 50) AS duration_blocks, coalesce(max(block) - min(block) FILTER (WHERE d > 50), 0) AS recovery_blocks FROM j GROUP BY state, date""")
def _(v):
    return wx.storm_events(v.frame, storms(v), 50.0)


@query("j14_monsoon_onset", "state year:i onset max_rolling:f", """
    WITH d AS (SELECT state, date, year(date) AS year, load / 100 AS rain FROM v_daily), r AS (SELECT *, CASE WHEN count(rain) OVER w >= 3 THEN sum(rain) OVER w END AS rr FROM d WINDOW w AS (PARTITION BY state, year ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT state, year, min(date) FILTER (WHERE rr > 25) AS onset, max(rr) AS max_rolling FROM r GROUP BY state, year""")
def _(v):
    return wx.monsoon_onset(v.daily.withColumn("rain", F.col("load") / 100))


@query("j15_regime_clusters", "state date cluster:i cluster_name avg_temp:f avg_hum:f")
def _(v):
    from quarterhour.operators.clusters import weather_clusters
    return weather_clusters(v.frame, storms(v))


_CC = ["temp_mean", "temp_max", "hum_mean", "rain_sum", "wind_max", "heat_proxy"]
_CTX = """cx AS (SELECT state, date, dn, avg(temperature) AS temp_mean, max(temperature) AS temp_max, avg(humidity) AS hum_mean, sum(precipitation) AS rain_sum, max(wind_speed_10m) AS wind_max, max(temperature) * (1 + avg(humidity) / 100) AS heat_proxy FROM v_t GROUP BY ALL),
    cy AS (SELECT *, """ + ", ".join(f"CASE WHEN count({c}) OVER w >= 3 THEN avg({c}) OVER w END AS {c}_avg, CASE WHEN count({c}) OVER w >= 3 THEN stddev_samp({c}) OVER w END AS {c}_sd" for c in _CC) + """ FROM cx WINDOW w AS (PARTITION BY state ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    cz AS (SELECT *, """ + ", ".join(f"{c} - {c}_avg AS {c}_delta, ({c} - {c}_avg) / nullif({c}_sd, 0) AS {c}_z" for c in _CC) + " FROM cy)"


@query("j16_daily_context", "state date " + " ".join(f"{c}:f {c}_avg:f {c}_delta:f {c}_z:f" for c in _CC), f"WITH {_CTX} SELECT * FROM cz")
def _(v):
    return wx.daily_context(v.frame)


def _fac(name, c, lim, rise, unit):
    return f"CASE WHEN {c} >= {lim} OR coalesce({c}_delta >= {rise}, false) THEN '{name} abnormality: ' || printf('%.1f', round({c} + 1e-9, 1)) || '{unit}' || CASE WHEN {c}_delta IS NOT NULL THEN ', ' || printf('%+.1f', round({c}_delta + 1e-9, 1) + CAST(0 AS DOUBLE)) || ' vs trailing 7d' ELSE '' END || '.' END"


@query("j17_abnormal_factor_text", "state date factors", f"""
    WITH {_CTX}, t AS (SELECT state, date, concat_ws(' ', {_fac('Heat', 'temp_max', 38, 3, 'C')}, {_fac('Humidity', 'hum_mean', 70, 8, '%')}, {_fac('Heat-index', 'heat_proxy', 60, 7, '')}, {_fac('Rain', 'rain_sum', 1, 1, ' mm')}, {_fac('Wind', 'wind_max', 18, 5, '')}) AS f FROM cz)
    SELECT state, date, CASE WHEN f = '' THEN 'No clear abnormal weather factor.' ELSE f END AS factors FROM t""")
def _(v):
    c = wx.daily_context(v.frame)
    return c.select("state", "date", wx.abnormal_factor(c).alias("factors"))


_IMP = """im AS (SELECT state, date, dn, avg(temperature) AS t, avg(humidity) AS h, sum(precipitation) AS rain, avg(cloud_cover) AS c FROM v_t GROUP BY ALL),
    ix AS (SELECT *, CASE WHEN t > 38 AND h < 40 THEN 'hot_dry' WHEN rain > 5 OR (h > 65 AND c > 60) THEN 'active_monsoon' ELSE 'pre_monsoon_humid' END AS regime,
      coalesce(sum(CASE WHEN rain > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY state, date_trunc('month', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rainy_days,
      max(rain) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS yday_rain FROM im),
    iy AS (SELECT *, coalesce(rain > 5 AND yday_rain < 1, false) AS first_rain, coalesce(rain > 5 AND yday_rain <= 1 AND rainy_days = 0, false) AS first_rain_event FROM ix)"""


@query("j18_capped_rain_delta", "state date block:i rain_delta:f first_rain", f"""
    WITH {_IMP}, d AS (SELECT *, precipitation - max(precipitation) OVER (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS d FROM v_t)
    SELECT d.state, d.date, d.block, CASE WHEN d IS NOT NULL THEN least(greatest(d, CASE WHEN first_rain THEN -3 ELSE -10 END), CASE WHEN first_rain THEN 3 ELSE 10 END) END AS rain_delta, first_rain FROM d JOIN iy USING (state, date)""")
def _(v):
    return wx.capped_rain_delta(v.frame)


@query("j19_weather_injection", "state date block:i temperature:f humidity:f", """
    WITH h AS (SELECT f.* FROM v_frame f WHERE date < DATE '2024-01-25'), dd AS (SELECT state, date, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM h GROUP BY state, date),
    n AS (SELECT *, (isodow(date) - isodow(DATE '2024-01-25') + 7) % 7 IN (0, 1, 6) AS near FROM dd WHERE r <= 60), k AS (SELECT *, count(*) FILTER (WHERE near) OVER (PARTITION BY state) AS kk FROM n),
    p AS (SELECT h.state, h.block, avg(temperature) AS temperature, avg(humidity) AS humidity FROM h JOIN k USING (state, date) WHERE kk < 3 OR near GROUP BY h.state, h.block)
    SELECT g.state, g.date, g.block, coalesce(w.temperature, p.temperature) AS temperature, coalesce(w.humidity, p.humidity) AS humidity FROM v_grid g LEFT JOIN v_wmean w USING (state, date, block) LEFT JOIN p USING (state, block)
    WHERE g.date = DATE '2024-01-25' """)
def _(v):
    target = v.grid.where(F.col("date") == F.lit("2024-01-25").cast("date"))
    cols = ("temperature", "humidity")
    return wx.fill_weather(target, v.wmean, wx.climate_proxy(v.frame, "2024-01-25", cols), cols)


@query("j20_saturations", "state date block:i rain_impact:f wind_impact:f solar_index:f", """
    SELECT state, date, block, CASE WHEN precipitation > 0 THEN ln(1 + precipitation) * (5 / ln(6)) ELSE 0 END * 15 * CASE WHEN block >= 70 THEN 1.8::DOUBLE ELSE 1 END AS rain_impact,
      ln(1 + greatest(0, coalesce(wind_speed_10m, 0) - 10)) / ln(31) * 8 * CASE WHEN block BETWEEN 33 AND 76 THEN 1.5::DOUBLE ELSE 1 END AS wind_impact,
      greatest(coalesce(direct_radiation, 0), 0) / greatest(max(direct_radiation) OVER (PARTITION BY state), 1) * (1 - coalesce(cloud_cover, 50) / 100) AS solar_index FROM v_frame""")
def _(v):
    return wx.saturations(v.frame, "winter", gust=10.0)


@query("j21_evening_storm", "state date block:i cut_mw:f adjustment:f adjusted:f", """
    WITH d AS (SELECT state, date, avg(wind_speed_10m) FILTER (WHERE block BETWEEN 69 AND 76) AS pw, sum(precipitation) FILTER (WHERE block BETWEEN 69 AND 88) AS pr FROM v_base GROUP BY state, date),
    c AS (SELECT state, date, CASE WHEN pw > 12 AND pr > 2 THEN least(6 * (pw - 12), 2000) ELSE 0 END AS cut_mw FROM d)
    SELECT b.state, b.date, b.block, cut_mw, -cut_mw * CASE WHEN block BETWEEN 73 AND 88 THEN 1 - 0.5::DOUBLE * (block - 73) / 15 ELSE 0 END AS adjustment,
      CASE WHEN block BETWEEN 73 AND 88 THEN CASE WHEN baseline IS NOT NULL THEN greatest(baseline - cut_mw * (1 - 0.5::DOUBLE * (block - 73) / 15), 0) END ELSE baseline END AS adjusted FROM v_base b JOIN c USING (state, date)""")
def _(v):
    return wx.evening_storm(v.base, "baseline", wind=12.0, rain=2.0, mw_per_kmh=6.0)


@query("j22_weighted_or_mean_weather", "state date block:i temperature:f humidity:f weighted", """
    WITH w AS (SELECT state, date, block, sum(weight * coalesce(temperature, 0)) / sum(weight) AS t, sum(weight * coalesce(humidity, 0)) / sum(weight) AS h FROM v_wloc JOIN v_dw USING (location) WHERE location <= 'D2' GROUP BY ALL),
    n AS (SELECT state, date, count(*) AS nb FROM w GROUP BY ALL)
    SELECT m.state, m.date, m.block, CASE WHEN coalesce(nb >= 40, false) THEN coalesce(t, m.temperature) ELSE m.temperature END AS temperature, CASE WHEN coalesce(nb >= 40, false) THEN coalesce(h, m.humidity) ELSE m.humidity END AS humidity, coalesce(nb >= 40, false) AS weighted
    FROM v_wmean m LEFT JOIN w USING (state, date, block) LEFT JOIN n USING (state, date)""")
def _(v):
    return wx.weighted_or_mean(v.wloc.where("location <= 'D2'"), v.dw, v.wmean, ("temperature", "humidity"), min_blocks=40)


@query("j23_temperature_deviation", "state date deviation:f", "SELECT state, date, coalesce(abs(avg(temperature) - avg(n_temp)), 0) AS deviation FROM v_base GROUP BY state, date")
def _(v):
    return wx.mean_temperature_gap(v.base)


@query("j24_impact_context", "state date regime rainy_days:i first_rain first_rain_event", f"WITH {_IMP} SELECT * FROM iy")
def _(v):
    return wx.impact_context(v.frame)


