"""2.F feature engineering."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.operators import features as ft
from quarterhour.operators.calendar import holiday_flag, transition_flags
from quarterhour.plans.design import design_matrix, feature_columns, state_series
from quarterhour.plans.final_frame import final_features

_TF = """hour, dow AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, month, is_weekend, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * dow / 7) AS dow_sin, cos(2 * pi() * dow / 7) AS dow_cos,
    sin(2 * pi() * (block - 1) / 96) AS block_sin, cos(2 * pi() * (block - 1) / 96) AS block_cos, CAST(hour IN (7, 8, 9, 18, 19, 20) AS INTEGER) AS is_peak_hour, CAST(hour <= 6 AS INTEGER) AS is_night,
    CAST(hour BETWEEN 9 AND 17 AS INTEGER) AS is_business_hour, temperature ** 2 AS temp_squared, temperature ** 3 AS temp_cubed, temperature * sin(2 * pi() * hour / 24) AS temperature_sin"""
_TFC = "hour:i day_of_week:i day_of_month:i month:i is_weekend:i hour_cos:f dow_sin:f dow_cos:f block_sin:f block_cos:f is_peak_hour:i is_night:i is_business_hour:i temp_squared:f temp_cubed:f temperature_sin:f"


@query("f1_final_features", "state date block:i load:f hour:i minute:i is_weekend:i is_holiday:i hour_cos:f block_sin:f block_cos:f is_peak_hour:i is_night:i is_business_hour:i temp_squared:f temperature_sin:f", """
    SELECT state, date, block, load, hour, ((block - 1) % 4) * 15 AS minute, is_weekend, is_holiday, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * block / 96) AS block_sin, cos(2 * pi() * block / 96) AS block_cos,
      CAST((hour >= 6 AND hour < 10) OR (hour >= 18 AND hour < 22) AS INTEGER) AS is_peak_hour, CAST(hour >= 22 OR hour < 6 AS INTEGER) AS is_night, CAST(hour >= 9 AND hour < 18 AND is_weekend = 0 AS INTEGER) AS is_business_hour,
      temperature ** 2 AS temp_squared, sin(2 * pi() * temperature / 40) AS temperature_sin FROM v_frame""")
def _(v):
    return final_features(v.load.join(v.wmean, ["state", "date", "block"], "left"), v.hol)


@query("f2_time_features", "state date block:i " + _TFC, f"SELECT state, date, block, {_TF} FROM v_frame")
def _(v):
    return ft.time_features(v.frame)


_EDA = ["season", "time_of_day", "is_monday:i", "is_friday:i", "days_to_holiday:i", "days_since_holiday:i", "bridge_day:i", "long_weekend:i", "cooling_degree:f", "heat_index:f", "rain_proxy:i", "rain_intensity",
        "d1:f", "d2:f", "d7:f", "temp_d1:f", "temp_d7:f", "temp_roll_3h:f", "temp_roll_6h:f", "temp_roll_7d:f", "hum_roll_7d:f", "roll7_block:f", "roll7_trend:f", "load_last_24:f", "dod_change:f", "wow_change:f",
        "temp_x_peak:f", "weather_x_load:f", "block_x_d1:f", "weekend_load:f", "holiday_load:f", "block_mean:f", "seasonal_profile:f", "weekly_profile:f", "baseline_dev:f", "block_std:f", "variance_score:f", "dev_score:f", "peak_volatility:i"]


@query("f3_exploration_frame", "state date block:i load:f " + " ".join(_EDA), "SELECT * FROM v_eda")
def _(v):
    return v.eda


_POLY = [f"{c}_{p}" for c in ("temperature", "humidity", "precipitation") for p in ("sq", "cb", "x_block_sin", "x_block_cos", "x_hour_sin", "x_hour_cos")]


@query("f3_weather_polynomials", "state date block:i " + " ".join(f"{p}:f" for p in _POLY), "SELECT state, date, block, " + ", ".join(
    f"{c} * {c} AS {c}_sq, {c} * {c} * {c} AS {c}_cb, " + ", ".join(f"{c} * {e} AS {c}_x_{e}" for e in ("block_sin", "block_cos", "hour_sin", "hour_cos")) for c in ("temperature", "humidity", "precipitation")) + " FROM v_eda1")
def _(v):
    return v.eda


@query("f4_kpi_features", "state date block:i cooling_degree_days:f heating_degree_days:f heat_index:f rain_flag:i humidity_index:f cloud_flag:i solar_index:f d1:f d7:f rolling_baseline:f rolling_volatility:f", """
    SELECT state, date, block, greatest(temperature - 24, 0) AS cooling_degree_days, greatest(18 - temperature, 0) AS heating_degree_days,
      0.5::DOUBLE * (temperature + 61 + (temperature - 68) * 1.2::DOUBLE + humidity * 0.094::DOUBLE) AS heat_index, CAST(precipitation > 0.1 AS INTEGER) AS rain_flag, humidity / 100 AS humidity_index,
      CAST(cloud_cover > 0.5 AS INTEGER) AS cloud_flag, least(direct_radiation / 1000, 1) AS solar_index, max(load) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS d1, max(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS d7,
      avg(load) OVER (s RANGE BETWEEN 671 PRECEDING AND CURRENT ROW) AS rolling_baseline, stddev_samp(load) OVER (s RANGE BETWEEN 671 PRECEDING AND CURRENT ROW) AS rolling_volatility
    FROM v_t WINDOW b AS (PARTITION BY state, block ORDER BY dn), s AS (PARTITION BY state ORDER BY t)""")
def _(v):
    return ft.kpi_features(v.frame)


_WB = ("({t} * atan(0.151977::DOUBLE * sqrt({h} + 8.313659::DOUBLE)) + atan({t} + {h}) - atan({h} - 1.676331::DOUBLE) + 0.00391838::DOUBLE * pow({h}, 1.5::DOUBLE) * atan(0.023101::DOUBLE * {h}) - 4.686035::DOUBLE)")
_TRAIN = ["cdd:f", "hdd:f", "wbgt:f", "solar_proxy_mw:f", "temp_quartic:f", "ramp_heat:f", "season_idx:i", "load_lag_1d:f", "load_lag_2d:f", "load_lag_3d:f", "load_lag_7d:f", "load_rolling_7d:f", "temp_roll_3h:f", "temp_roll_6h:f",
          "lag_block_1:f", "lag_block_4:f", "rolling_4:f", "rolling_12:f", "cdh_24h:f", "cdh_48h:f", "cdh_72h:f", "load_trend_3d:f", "prev_night_dip:f", "load_x_cdd:f", "load_x_humidity:f", "cdd_squared:f", "wbgt_x_load:f", "temp_momentum_3d:f"]


@query("f5_training_frame", "state date block:i " + " ".join(_TRAIN), f"""
    WITH a AS (SELECT *, greatest(temperature - 24, 0) AS cdd, greatest(15 - temperature, 0) AS hdd, 0.7::DOUBLE * {_WB.format(t='temperature', h='least(greatest(humidity, 0), 100)')} + 0.3::DOUBLE * temperature AS wbgt,
        greatest(coalesce(direct_radiation, 0), 0) * (1 - least(greatest(coalesce(cloud_cover, 50), 0), 100) / 100) * 0.001::DOUBLE AS solar_proxy_mw, temperature ** 4 / 1e6 AS temp_quartic,
        temperature * CASE WHEN block BETWEEN 48 AND 68 THEN 1 ELSE 0 END AS ramp_heat, CASE WHEN month IN (12,1,2) THEN 0 WHEN month <= 5 THEN 1 WHEN month <= 8 THEN 2 ELSE 3 END AS season_idx FROM v_t),
    b AS (SELECT *, max(load) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS load_lag_1d, max(load) OVER (b RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS load_lag_2d,
        max(load) OVER (b RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS load_lag_3d, max(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS load_lag_7d,
        avg(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS load_rolling_7d, max(temperature) OVER (b RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS t3,
        avg(temperature) OVER (s RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS temp_roll_3h, avg(temperature) OVER (s RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS temp_roll_6h,
        max(load) OVER (s RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_block_1, max(load) OVER (s RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS lag_block_4,
        avg(load) OVER (s RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_4, avg(load) OVER (s RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_12,
        sum(cdd) OVER (s RANGE BETWEEN 95 PRECEDING AND CURRENT ROW) AS cdh_24h, sum(cdd) OVER (s RANGE BETWEEN 191 PRECEDING AND CURRENT ROW) AS cdh_48h, sum(cdd) OVER (s RANGE BETWEEN 287 PRECEDING AND CURRENT ROW) AS cdh_72h
      FROM a WINDOW b AS (PARTITION BY state, block ORDER BY dn), s AS (PARTITION BY state ORDER BY t)),
    d AS (SELECT state, date, dn, avg(load) AS dm, avg(load) FILTER (WHERE block <= 32) AS nm FROM v_t GROUP BY state, date, dn),
    e AS (SELECT *, dm - max(dm) OVER (w RANGE BETWEEN 3 PRECEDING AND 3 PRECEDING) AS load_trend_3d, max(nm) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pn,
        CASE WHEN count(nm) OVER (w RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING) >= 2 THEN avg(nm) OVER (w RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING) END AS pr FROM d WINDOW w AS (PARTITION BY state ORDER BY dn))
    SELECT b.*, load_trend_3d, CASE WHEN abs(pn - pr) / pr > 0.15 THEN 1 ELSE 0 END AS prev_night_dip, load_lag_1d * cdd AS load_x_cdd, load_lag_1d * humidity / 100 AS load_x_humidity, cdd * cdd AS cdd_squared, wbgt * load_rolling_7d AS wbgt_x_load,
      temperature - coalesce(t3, temperature) AS temp_momentum_3d FROM b JOIN e USING (state, date)""")
def _(v):
    return ft.training_frame(v.frame)


@query("f6_thermal_solar", "state date block:i cdd:f hdd:f wbgt:f cdh_24h:f temp_momentum_3d:f solar_index:f precip_severity:f wind_severity:f is_extreme_heat:i is_extreme_cold:i", f"""
    WITH a AS (SELECT *, coalesce(temperature, 25) AS tt, coalesce(humidity, 50) AS hh, coalesce(direct_radiation, 0) AS rr, least(greatest(coalesce(cloud_cover, 0), 0), 100) AS cc FROM v_t),
    b AS (SELECT *, greatest(tt - 24, 0) AS cdd, greatest(15 - tt, 0) AS hdd, 0.7::DOUBLE * {_WB.format(t='tt', h='hh')} + 0.3::DOUBLE * tt AS wbgt, greatest(max(rr) OVER (PARTITION BY state), 1) AS mx FROM a)
    SELECT state, date, block, cdd, hdd, wbgt, sum(cdd) OVER (s RANGE BETWEEN 95 PRECEDING AND CURRENT ROW) AS cdh_24h, tt - max(tt) OVER (s RANGE BETWEEN 288 PRECEDING AND 288 PRECEDING) AS temp_momentum_3d, rr / mx * (1 - cc / 100) AS solar_index,
      least(greatest(ln(1 + coalesce(precipitation, 0)) / ln(11), 0), 1) AS precip_severity, least(greatest((coalesce(wind_speed_10m, 0) - 15) / 30, 0), 1) AS wind_severity, CAST(tt >= 42 AS INTEGER) AS is_extreme_heat, CAST(tt <= 8 AS INTEGER) AS is_extreme_cold
    FROM b WINDOW s AS (PARTITION BY state ORDER BY t)""")
def _(v):
    return ft.thermal_solar(v.frame)


_WX = ("temperature", "humidity", "precipitation", "cloud_cover", "direct_radiation", "wind_speed_10m")


@query("f7_weather_deltas", "state date block:i " + " ".join(f"{c}_delta:f" for c in _WX), "SELECT state, date, block, " + ", ".join(
    f"{c} - max({c}) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS {c}_delta" for c in _WX) + " FROM v_t WINDOW w AS (PARTITION BY state, block ORDER BY dn)")
def _(v):
    return ft.weather_deltas(v.frame)


@query("f8_guarded_lags", "state date block:i lag_1d:f lag_7d:f load_rolling_7d:f day_anomalous prev_anomalous", """
    WITH d AS (SELECT state, date, dn, avg(load) AS m FROM v_t GROUP BY ALL),
    w AS (SELECT *, coalesce(abs(m - avg(m) OVER p) > 1.2::DOUBLE * greatest(coalesce(stddev_samp(m) OVER p, 0), 1), false) AS bad FROM d WINDOW p AS (PARTITION BY state ORDER BY dn RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING)),
    x AS (SELECT *, coalesce(max(CAST(bad AS INTEGER)) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) = 1 AS pbad FROM w),
    l AS (SELECT *, max(load) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS l1, max(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS lag_7d, avg(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS load_rolling_7d
      FROM v_t WINDOW b AS (PARTITION BY state, block ORDER BY dn))
    SELECT l.state, l.date, l.block, CASE WHEN pbad THEN lag_7d ELSE l1 END AS lag_1d, lag_7d, load_rolling_7d, bad AS day_anomalous, pbad AS prev_anomalous FROM l JOIN x USING (state, date)""")
def _(v):
    return ft.guarded_lags(v.load, sigma=1.2)


_ROT = """r AS (SELECT *, CAST(CASE WHEN block < 33 THEN date - 1 ELSE date END AS DATE) AS rot_date, ((block - 33 + 96) % 96) + 1 AS rot_block FROM v_frame)"""


@query("f9_rotated_features", "state date block:i rot_date rot_block:i rot_block_sin:f rot_block_cos:f dow_sin:f dow_cos:f is_sunday:i is_weekend:i is_peak_hour:i is_night:i", f"""
    WITH {_ROT}, x AS (SELECT *, isodow(rot_date) - 1 AS d FROM r)
    SELECT state, date, block, rot_date, rot_block, sin(2 * pi() * (rot_block - 1) / 96) AS rot_block_sin, cos(2 * pi() * (rot_block - 1) / 96) AS rot_block_cos, sin(2 * pi() * d / 7) AS dow_sin, cos(2 * pi() * d / 7) AS dow_cos,
      CAST(d = 6 AS INTEGER) AS is_sunday, CAST(d >= 5 AS INTEGER) AS is_weekend, CAST(hour IN (7, 8, 9, 18, 19, 20) AS INTEGER) AS is_peak_hour, CAST(hour <= 6 AS INTEGER) AS is_night FROM x""")
def _(v):
    return ft.rotated_features(v.load)


_RD = """c AS (SELECT d.date, d.off FROM (SELECT date, CAST(isodow(date) >= 6 OR date IN (SELECT holiday FROM v_hol) AS BOOLEAN) AS off FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date)) d),
    hd AS (SELECT DISTINCT state, date FROM v_load),
    cand AS (SELECT t.state, t.date AS target, k.date AS cand, {h} AS h, ROW_NUMBER() OVER (PARTITION BY t.state, t.date ORDER BY k.date DESC) AS rk, ct.off = ck.off AS same
      FROM hd t JOIN hd k ON k.state = t.state AND k.date <= t.date - {h} AND k.date > t.date - {h} - 14 JOIN c ct ON ct.date = t.date JOIN c ck ON ck.date = k.date),
    m AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state, target ORDER BY cand DESC) AS mr FROM cand WHERE same), en AS (SELECT state, target, count(*) AS n FROM m WHERE mr <= 3 GROUP BY ALL),
    chosen AS (SELECT m.state, m.target, m.cand FROM m JOIN en USING (state, target) WHERE mr <= 3 AND n >= 3
      UNION ALL SELECT t.state, t.date, k.date FROM hd t LEFT JOIN en ON en.state = t.state AND en.target = t.date JOIN hd k ON k.state = t.state AND k.date <= t.date - {h} AND k.date > t.date - {h} - 3 WHERE coalesce(en.n, 0) < 3),
    rd AS (SELECT ch.state, ch.target AS date, l.block, avg(l.load) AS recent_day_baseline FROM chosen ch JOIN v_load l ON l.state = ch.state AND l.date = ch.cand GROUP BY ALL)"""


@query("f10_design_matrix", "state date block:i origin_date load:f lag_h_load:f lag_7d_load:f lag_14d_load:f roll7_mean_load:f roll7_std_load:f origin_daily_mean_load:f origin_last_block_load:f recent_day_baseline:f block_sin:f dow_cos:f month_sin:f is_weekend:i is_holiday:i days_to_holiday:i temp_wmean:f temp_wmean_delta_origin:f", f"""
    WITH {_RD.format(h=2)},
    g AS (SELECT g.*, CAST(g.date - DATE '1970-01-01' AS BIGINT) AS dn FROM v_grid g),
    w AS (SELECT *, max(load) OVER (b RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS lag_h_load, max(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS lag_7d_load, max(load) OVER (b RANGE BETWEEN 14 PRECEDING AND 14 PRECEDING) AS lag_14d_load,
      avg(load) OVER (b RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING) AS roll7_mean_load, stddev_pop(load) OVER (b RANGE BETWEEN 8 PRECEDING AND 2 PRECEDING) AS roll7_std_load FROM g WINDOW b AS (PARTITION BY state, block ORDER BY dn)),
    o AS (SELECT state, CAST(date + 2 AS DATE) AS date, avg(load) AS origin_daily_mean_load, max(load) FILTER (WHERE block = 96) AS origin_last_block_load FROM v_load GROUP BY ALL),
    h AS (SELECT d.date, least(coalesce(min(h.holiday - d.date) FILTER (WHERE h.holiday >= d.date), 7), 7) AS days_to_holiday, CAST(max(h.holiday = d.date) AS INTEGER) AS is_holiday
      FROM (SELECT DISTINCT date FROM v_grid) d CROSS JOIN v_hol h GROUP BY d.date),
    x AS (SELECT state, date, block, sum(weight * temperature) / sum(weight) FILTER (WHERE temperature IS NOT NULL) AS tw FROM v_wloc JOIN v_dw USING (location) GROUP BY ALL)
    SELECT w.state, w.date, w.block, CAST(w.date - 2 AS DATE) AS origin_date, w.load, lag_h_load, lag_7d_load, lag_14d_load, roll7_mean_load, roll7_std_load, origin_daily_mean_load, origin_last_block_load, rd.recent_day_baseline,
      sin(2 * pi() * (w.block - 1) / 96) AS block_sin, cos(2 * pi() * (isodow(w.date) - 1) / 7) AS dow_cos, sin(2 * pi() * (month(w.date) - 1) / 12) AS month_sin, CAST(isodow(w.date) >= 6 AS INTEGER) AS is_weekend, is_holiday, days_to_holiday,
      a.tw AS temp_wmean, a.tw - b.tw AS temp_wmean_delta_origin
    FROM w LEFT JOIN o USING (state, date) LEFT JOIN rd USING (state, date, block) LEFT JOIN h USING (date) LEFT JOIN x a ON a.state = w.state AND a.date = w.date AND a.block = w.block
    LEFT JOIN x b ON b.state = w.state AND b.date = w.date - 2 AND b.block = w.block""")
def _(v):
    from quarterhour.functions.stats import weighted_avg
    wx = v.wloc.join(v.dw, "location").groupBy("state", "date", "block").agg(weighted_avg("temperature", "weight").alias("temp_wmean"))
    return design_matrix(v.grid, wx, v.hol, horizon=2)


@query("f11_feature_groups", "state feature filled:i", """
    WITH g AS (SELECT g.*, CAST(g.date - DATE '1970-01-01' AS BIGINT) AS dn FROM v_grid g),
    w AS (SELECT state, max(load) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS lag_h_load, max(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS lag_7d_load, max(load) OVER (b RANGE BETWEEN 14 PRECEDING AND 14 PRECEDING) AS lag_14d_load,
      avg(load) OVER (b RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS roll7_mean_load FROM g WINDOW b AS (PARTITION BY state, block ORDER BY dn))
    SELECT state, 'lag_h_load' AS feature, count(lag_h_load) AS filled FROM w GROUP BY state UNION ALL SELECT state, 'lag_7d_load', count(lag_7d_load) FROM w GROUP BY state
    UNION ALL SELECT state, 'lag_14d_load', count(lag_14d_load) FROM w GROUP BY state UNION ALL SELECT state, 'roll7_mean_load', count(roll7_mean_load) FROM w GROUP BY state""")
def _(v):
    names = feature_columns(["base"])[:4]
    d = design_matrix(v.grid, None, v.hol, horizon=1).select("state", *names)
    long = d.select("state", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in names])).alias("p")).select("state", "p.*")
    return long.groupBy("state", "feature").agg(F.count("x").alias("filled"))


@query("f12_training_windows", "state rot_date history_blocks:i future_blocks:i history_load:f future_load:f", """
    WITH r AS (SELECT *, CAST(CASE WHEN block < 33 THEN date - 1 ELSE date END AS DATE) AS rd FROM v_load), d AS (SELECT state, rd, count(*) AS n, sum(load) AS s FROM r GROUP BY state, rd)
    SELECT f.state, f.rd AS rot_date, h.n AS history_blocks, f.n AS future_blocks, h.s AS history_load, f.s AS future_load FROM d f JOIN d h ON h.state = f.state AND h.rd = f.rd - 1
    WHERE h.n >= 48 AND f.n >= 48""")
def _(v):
    w = ft.training_windows(v.load, ["load"], history_share=0.5, future_share=0.5)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["load"])
    return w.select("state", "rot_date", F.size("history").alias("history_blocks"), F.size("future").alias("future_blocks"), total("history").alias("history_load"), total("future").alias("future_load"))


@query("f13_sample_weights", "state date block:i weight:f", f"""
    WITH {_ROT}, x AS (SELECT *, CAST(isodow(rot_date) = 7 AS INTEGER) AS sunday, coalesce(temperature - lag(temperature) OVER (PARTITION BY state, rot_date ORDER BY rot_block), 0) AS dt FROM r)
    SELECT state, date, block, least(greatest(1 + 0.8::DOUBLE * abs(dt) + 1.8::DOUBLE * ln(1 + greatest(0, coalesce(precipitation, 0))) + 1.5::DOUBLE * greatest(0, coalesce(wind_speed_10m, 0) - 15) / 30 + 0.8::DOUBLE * sunday + 1.2::DOUBLE * is_holiday, 1), 6) AS weight FROM x""")
def _(v):
    return ft.sample_weights(ft.rotated_features(v.frame))


@query("f14_inference_frame", "state date block:i is_target:i load_source:f", """
    SELECT state, date, block, 0 AS is_target, load AS load_source FROM v_load WHERE date < DATE '2024-01-25'
    UNION ALL SELECT state, date, block, 1, coalesce(CASE WHEN block <= 40 THEN load END, baseline) FROM v_base WHERE date = DATE '2024-01-25' """)
def _(v):
    d = F.lit("2024-01-25").cast("date")
    target = v.base.where(F.col("date") == d).withColumn("load", F.when(F.col("block") <= 40, F.col("load"))).select("state", "date", "block", "load", "baseline")
    return ft.inference_frame(v.load.where(F.col("date") < d), target)


@query("f15_median_imputation", "state date block:i temperature:f humidity:f", """
    WITH g AS (SELECT v_grid.state, v_grid.date, v_grid.block, temperature, humidity FROM v_grid LEFT JOIN v_wmean USING (state, date, block)),
    b AS (SELECT state, block, median(temperature) AS bt, median(humidity) AS bh FROM g GROUP BY ALL), s AS (SELECT state, median(temperature) AS st, median(humidity) AS sh FROM g GROUP BY ALL)
    SELECT g.state, g.date, g.block, coalesce(temperature, bt, st) AS temperature, coalesce(humidity, bh, sh) AS humidity FROM g JOIN b USING (state, block) JOIN s USING (state)""")
def _(v):
    g = v.grid.select("state", "date", "block").join(v.wmean, ["state", "date", "block"], "left")
    return ft.impute_median(g, ["temperature", "humidity"])


@query("f16_state_series", "state date block:i rot_date rot_block:i y:f baseline:f residual:f lag_7d:f temperature_delta:f cdd:f is_sunday:i is_holiday:i", f"""
    WITH {_ROT}, rt AS (SELECT *, CAST(rot_date - DATE '1970-01-01' AS BIGINT) AS rn FROM r),
    b AS (SELECT *, avg(load) OVER (PARTITION BY state, rot_block ORDER BY rn RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING) AS baseline FROM rt),
    l AS (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) AS dn FROM b)
    SELECT state, date, block, rot_date, rot_block, load AS y, baseline, load - baseline AS residual, max(load) OVER (w RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS lag_7d,
      temperature - max(temperature) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS temperature_delta, greatest(coalesce(temperature, 25) - 24, 0) AS cdd, CAST(isodow(rot_date) = 7 AS INTEGER) AS is_sunday, is_holiday
    FROM l WINDOW w AS (PARTITION BY state, block ORDER BY dn)""")
def _(v):
    return state_series(v.frame)


@query("f2_holiday_features", "date is_holiday:i holiday_on_weekday:i bridge_day:i long_weekend:i midweek_holiday:i", """
    WITH d AS (SELECT DISTINCT date FROM v_daily), x AS (SELECT date, isodow(date) - 1 AS dow, date IN (SELECT holiday FROM v_hol) AS h, CAST(date + 1 AS DATE) IN (SELECT holiday FROM v_hol) OR CAST(date - 1 AS DATE) IN (SELECT holiday FROM v_hol) AS adj FROM d)
    SELECT date, CAST(h AS INTEGER) AS is_holiday, CAST(h AND dow < 5 AS INTEGER) AS holiday_on_weekday, CAST(NOT h AND dow < 5 AND adj AS INTEGER) AS bridge_day, CAST(dow >= 5 AND adj AS INTEGER) AS long_weekend, CAST(h AND dow BETWEEN 1 AND 3 AS INTEGER) AS midweek_holiday FROM x""")
def _(v):
    return transition_flags(v.daily.select("date").distinct(), v.hol)


@query("f1_holiday_flag", "date is_holiday:i", "SELECT DISTINCT date, CAST(date IN (SELECT holiday FROM v_hol) AS INTEGER) AS is_holiday FROM v_daily")
def _(v):
    return holiday_flag(v.daily.select("date").distinct(), v.hol)
