"""2.D aggregations and KPIs (second half: day statistics and diagnostics)."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.d_kpis import fa
from quarterhour.catalog.sqlparts import spearman, spearman_wide
from quarterhour.functions.stats import rank_corr, rank_corr_wide
from quarterhour.operators import day_stats as ds
from quarterhour.plans import views as view_registry


def inw(lo, hi):
    return f"block BETWEEN {lo} AND {hi}" if lo <= hi else f"(block >= {lo} OR block <= {hi})"


def part(parts):
    return "CASE " + " ".join(f"WHEN {inw(lo, hi)} THEN '{n}'" for n, lo, hi in parts) + " END"


@query("d35_day_type_metrics", "state weekday_avg:f weekend_avg:f weekend_change_pct:f baseline_outlier_days:i completeness_pct:f precip_response_pct:f", f"""
    WITH d AS (SELECT state, date, sum(load) AS total, count(*) AS n, max(is_weekend) AS we FROM v_frame GROUP BY state, date),
    x AS (SELECT *, dense_rank() OVER (PARTITION BY state ORDER BY date DESC) AS r, avg(total) OVER (PARTITION BY state) AS m, stddev_samp(total) OVER (PARTITION BY state) AS s FROM d),
    a AS (SELECT state, {fa('we = 0', 'total')} AS weekday_avg, {fa('we = 1', 'total')} AS weekend_avg, count(*) FILTER (WHERE abs(total - m) > 2 * s) AS baseline_outlier_days,
      sum(n) FILTER (WHERE r <= 30) * 100.0::DOUBLE / (count(*) FILTER (WHERE r <= 30) * 96) AS completeness_pct FROM x GROUP BY state),
    p AS (SELECT state, ({fa('precipitation = 0')} - {fa('precipitation > 0')}) / greatest({fa('precipitation = 0')}, 1e-6) * 100 AS precip_response_pct FROM v_frame GROUP BY state)
    SELECT *, (weekday_avg - weekend_avg) / weekday_avg * 100 AS weekend_change_pct FROM a JOIN p USING (state)""")
def _(v):
    return ds.day_type_metrics(v.frame)


@query("d36_baseline_quality", "state score:f days:i completeness_pct:f std:f stability:f weather_similarity:f", """
    WITH b AS (SELECT * FROM v_frame WHERE date >= DATE '2024-01-15' AND date < DATE '2024-01-22'),
    d AS (SELECT state, date, sum(load) AS total, count(*) AS n FROM b GROUP BY state, date),
    s AS (SELECT state, count(*) AS days, sum(n) AS blocks, coalesce(stddev_samp(total), 0) AS std, avg(total) AS mean FROM d GROUP BY state),
    w AS (SELECT state, avg(temperature) AS t, avg(humidity) AS h, avg(precipitation) AS p FROM b GROUP BY state),
    a AS (SELECT state, avg(temperature) AS t, avg(humidity) AS h, avg(precipitation) AS p FROM v_frame WHERE date = DATE '2024-01-22' GROUP BY state),
    j AS (SELECT s.*, blocks / (days * 96.0::DOUBLE) * 100 AS completeness_pct, greatest(0, 100 - std / greatest(mean, 1e-6) * 100) AS stability,
      greatest(0, 100 - (abs(a.t - w.t) / (abs(w.t) + 1) + abs(a.h - w.h) / (abs(w.h) + 1) + abs(a.p - w.p) / (abs(w.p) + 1)) / 3 * 100) AS weather_similarity FROM s JOIN w USING (state) JOIN a USING (state))
    SELECT state, 0.4::DOUBLE * least(1, days / 7.0::DOUBLE) * 100 + 0.25::DOUBLE * completeness_pct + 0.25::DOUBLE * stability + 0.1::DOUBLE * weather_similarity AS score, days, completeness_pct, std, stability, weather_similarity FROM j""")
def _(v):
    return ds.baseline_quality(v.frame, "2024-01-22")


@query("d37_intraday_weather", "state date block:i temperature:f n_temp:f temp_delta:f hum_delta:f rain_delta:f temperature_dod:f humidity_dod:f precipitation_dod:f", """
    SELECT state, date, block, temperature, n_temp, temperature - n_temp AS temp_delta, humidity - n_hum AS hum_delta, precipitation - n_rain AS rain_delta,
      temperature - max(temperature) OVER w AS temperature_dod, humidity - max(humidity) OVER w AS humidity_dod, precipitation - max(precipitation) OVER w AS precipitation_dod
    FROM v_base WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)""")
def _(v):
    return ds.intraday_weather(v.base)


@query("d37_weather_windows", "state date window temp_avg:f temp_delta:f hum_avg:f hum_delta:f precip_total:f status", f"""
    WITH a AS (SELECT state, date, {part(ds.WEATHER_WINDOWS)} AS "window", avg(temperature) AS temp_avg, avg(temperature) - avg(n_temp) AS temp_delta, avg(humidity) AS hum_avg,
      avg(humidity) - avg(n_hum) AS hum_delta, sum(precipitation) AS precip_total FROM v_base GROUP BY ALL)
    SELECT *, CASE WHEN temp_delta > 3 THEN 'Heat Stress' WHEN temp_delta < -3 THEN 'Cold Stress' ELSE 'Normal' END AS status FROM a""")
def _(v):
    return ds.weather_windows(v.base)


@query("d37_rain_and_change", "state date rain_mm:f max_intensity:f rain_hours:f max_temp:f min_temp:f avg_humidity:f max_temp_change:f min_temp_change:f avg_humidity_change:f", """
    WITH a AS (SELECT state, date, sum(precipitation) AS rain_mm, max(precipitation) AS max_intensity, count(*) FILTER (WHERE precipitation > 0) * 0.25::DOUBLE AS rain_hours, max(temperature) AS max_temp,
      min(temperature) AS min_temp, avg(humidity) AS avg_humidity FROM v_base GROUP BY state, date)
    SELECT a.*, a.max_temp - b.max_temp AS max_temp_change, a.min_temp - b.min_temp AS min_temp_change, a.avg_humidity - b.avg_humidity AS avg_humidity_change FROM a LEFT JOIN a b ON b.state = a.state AND b.date = a.date - 1""")
def _(v):
    return ds.rain_and_change(v.frame)


@query("d38_window_deltas", "state date " + " ".join(f"{n}_delta_mw:f" for n, _, _ in ds.DELTA_WINDOWS), "SELECT state, date, " + ", ".join(
    f"coalesce(sum(load - baseline) FILTER (WHERE {inw(lo, hi)}), 0) AS {n}_delta_mw" for n, lo, hi in ds.DELTA_WINDOWS) + " FROM v_base GROUP BY state, date")
def _(v):
    return ds.window_deltas(v.base)


@query("d39_daily_load_change", "state date value:f blocks_compared:i", """
    WITH c AS (SELECT a.state, a.date, count(*) AS n, avg(a.load) AS c, avg(b.load) AS p FROM v_load a JOIN v_load b ON b.state = a.state AND b.block = a.block AND b.date = a.date - 1 WHERE a.load > 0 AND b.load > 0 GROUP BY a.state, a.date)
    SELECT state, date, (c - p) / p * 100 AS value, n AS blocks_compared FROM c WHERE n >= 40""")
def _(v):
    return ds.daily_change(v.load, min_common=40)


@query("d39_block_change", "state block:i change_pct:f", """
    SELECT state, block, (max(load) FILTER (WHERE date = DATE '2024-01-17') - max(load) FILTER (WHERE date = DATE '2024-01-10')) / max(load) FILTER (WHERE date = DATE '2024-01-10') * 100 AS change_pct
    FROM (SELECT * FROM v_load WHERE load > 0 AND date IN (DATE '2024-01-10', DATE '2024-01-17')) GROUP BY state, block""")
def _(v):
    return ds.block_change(v.load, "2024-01-17", "2024-01-10")


_PROF = ("peak:f valley:f peak_block:i energy_mwh:f avg:f load_factor:f valid_blocks:i max_ramp_up:f max_ramp_down:f max_deviation:f avg_deviation:f pv_ratio:f duck_severity:f "
         "night_base:f morning_ramp:f afternoon_plateau:f evening_peak:f duck_flag")


@query("d40_day_profile", "state date " + _PROF, """
    WITH x AS (SELECT c.*, load - max(load) OVER (PARTITION BY state, date ORDER BY block RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ramp,
        load - max(load) OVER (PARTITION BY state, block ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS dev FROM v_cal c),
    h AS (SELECT state, date, avg(m) FILTER (WHERE hour < 6) AS night_base, max(m) FILTER (WHERE hour = 10) - max(m) FILTER (WHERE hour = 6) AS morning_ramp, avg(m) FILTER (WHERE hour BETWEEN 12 AND 16) AS afternoon_plateau,
        avg(m) FILTER (WHERE hour BETWEEN 18 AND 20) AS evening_peak FROM (SELECT state, date, hour, avg(load) AS m FROM v_cal GROUP BY ALL) GROUP BY state, date),
    a AS (SELECT state, date, max(load) AS peak, min(load) FILTER (WHERE load > 0) AS valley, arg_max(block, (load, -block)) AS peak_block, sum(load) * 0.25::DOUBLE AS energy_mwh, avg(load) AS avg, avg(load) / max(load) * 100 AS load_factor,
        count(load) AS valid_blocks, max(ramp) AS max_ramp_up, min(ramp) AS max_ramp_down, max(abs(dev)) AS max_deviation, avg(abs(dev)) AS avg_deviation, max(load) / min(load) FILTER (WHERE load > 0) AS pv_ratio,
        min(load) FILTER (WHERE block BETWEEN 40 AND 56 AND load > 0) / nullif(max(load) FILTER (WHERE block BETWEEN 44 AND 56), 0) AS duck_severity FROM x GROUP BY state, date)
    SELECT *, coalesce(duck_severity < 0.65, false) AS duck_flag FROM a JOIN h USING (state, date)""")
def _(v):
    return ds.day_profile(v.cal)


@query("d41_time_of_day_groups", "state date tod avg_load:f peak_mw:f energy_mwh:f", f"""
    SELECT state, date, {part(ds.TOD_GROUPS)} AS tod, avg(load) AS avg_load, max(load) AS peak_mw, sum(load) * 0.25::DOUBLE AS energy_mwh FROM v_load GROUP BY ALL""")
def _(v):
    return ds.tod_groups(v.load)


@query("d41_two_sigma_flags", "state date block:i tod load:f", f"""
    WITH t AS (SELECT *, {part(ds.TOD_GROUPS)} AS tod FROM v_load WHERE load > 0), s AS (SELECT *, avg(load) OVER w AS m, stddev_pop(load) OVER w AS sd FROM t WINDOW w AS (PARTITION BY state, date, tod))
    SELECT state, date, block, tod, load FROM s WHERE sd > 0 AND abs(load - m) > 2 * sd""")
def _(v):
    return ds.tod_flags(v.load)


_FCOLS = ["load", "temperature", "humidity", "cloud_cover", "precipitation", "direct_radiation"]


@query("d42_feature_stats", "state column median:f iqr:f kurtosis:f", " UNION ALL ".join(
    f"SELECT state, '{c}' AS \"column\", median({c}) AS median, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, kurtosis({c}) AS kurtosis FROM v_frame GROUP BY state" for c in _FCOLS[:4]))
def _(v):
    return ds.feature_stats(v.frame, _FCOLS[:4])


_MP = {f"{a}|{b}": (a, b) for i, a in enumerate(_FCOLS) for b in _FCOLS[i:]}


@query("d42_spearman_matrix", "state a b rho:f", f"""
    WITH m AS (SELECT state, split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, rho FROM ({spearman('v_frame', 'state', _MP)}))
    SELECT * FROM m UNION ALL SELECT state, b, a, rho FROM m WHERE a <> b""")
def _(v):
    return ds.correlation_matrix(v.frame, _FCOLS)


@query("d42_strongest_pair", "state a b rho:f", f"""
    WITH m AS (SELECT state, split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, rho FROM ({spearman('v_frame', 'state', {p: ab for p, ab in _MP.items() if ab[0] != ab[1]})})),
    n AS (SELECT state, least(a, b) AS a, greatest(a, b) AS b, rho FROM m)
    SELECT state, a, b, rho FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY round(abs(rho), 9) DESC, a DESC, b DESC) AS rn FROM n) WHERE rn = 1""")
def _(v):
    return ds.strongest_pair(ds.correlation_matrix(v.frame, _FCOLS))


@query("d43_weather_regime_day", "state date comfort:f regime multiplier:f net_mw:f solar_drop_pct:f solar_risk", """
    WITH d AS (SELECT state, date, avg(temperature) AS t, max(temperature) AS tx, avg(humidity) AS h, sum(precipitation) AS p, avg(cloud_cover) AS c, avg(wind_speed_10m) AS w,
      max(direct_radiation) FILTER (WHERE block BETWEEN 32 AND 48) AS smax, min(direct_radiation) FILTER (WHERE block BETWEEN 32 AND 48) AS smin FROM v_frame GROUP BY state, date),
    x AS (SELECT *, CASE WHEN tx > 35 AND h > 65 THEN 1.25::DOUBLE ELSE 1 END * CASE WHEN tx > 38 AND h < 30 AND w < 10 THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN p > 5 AND c > 70 THEN 0.85::DOUBLE ELSE 1 END AS multiplier,
      (smax - smin) / nullif(smax, 0) * 100 AS drop_pct FROM d)
    SELECT state, date, greatest(0, least(100, 100 - CASE WHEN tx > 35 THEN (tx - 35) * 6 WHEN tx > 30 THEN (tx - 30) * 3 ELSE 0 END - CASE WHEN h > 70 THEN (h - 70) * 0.5::DOUBLE ELSE 0 END
        - CASE WHEN p > 5 THEN least(15, p * 1.5::DOUBLE) ELSE 0 END)) AS comfort,
      CASE WHEN tx > 42 THEN 'Extreme Heat' WHEN p > 10 AND c > 70 THEN 'Rainy' WHEN tx > 38 AND h < 35 THEN 'Hot & Dry' WHEN tx > 35 AND h > 65 THEN 'Hot & Humid' WHEN tx < 28 AND c > 60 THEN 'Cool & Cloudy' ELSE 'Normal' END AS regime,
      multiplier, (32 * greatest(0, t - 28) + 7 * greatest(0, h - 60) - 3 * c - 18 * least(greatest(0, p), 20) - 1.8::DOUBLE * greatest(0, w - 20)) * multiplier AS net_mw,
      CASE WHEN smax > 50 THEN drop_pct END AS solar_drop_pct, coalesce(smax > 50 AND drop_pct > 30, false) AS solar_risk FROM x""")
def _(v):
    return ds.weather_regime_day(v.frame)


@query("d44_residual_diagnostics", "state date mean:f median:f std:f mae:f outlier_pct:f mape:f longest_run:i worst_window systematic grade bias", f"""
    WITH r AS (SELECT *, actual - forecast AS r, stddev_pop(actual - forecast) OVER (PARTITION BY state, date) AS s, CASE WHEN actual - forecast > 0 THEN 1 ELSE -1 END AS sg FROM v_pair),
    g AS (SELECT *, sum(CASE WHEN sg = ps THEN 0 ELSE 1 END) OVER (PARTITION BY state, date ORDER BY block) AS run FROM (SELECT *, lag(sg) OVER (PARTITION BY state, date ORDER BY block) AS ps FROM r)),
    l AS (SELECT state, date, max(n) AS longest_run FROM (SELECT state, date, run, count(*) AS n FROM g GROUP BY ALL) GROUP BY state, date),
    w AS (SELECT state, date, arg_max(w, (m, w)) AS worst_window FROM (SELECT state, date, {part(ds.RESIDUAL_WINDOWS)} AS w, avg(abs(r)) AS m FROM r GROUP BY ALL) GROUP BY state, date),
    a AS (SELECT state, date, avg(r) AS mean, median(r) AS median, stddev_pop(r) AS std, avg(abs(r)) AS mae, avg(CASE WHEN abs(r) > 2 * s THEN 100.0::DOUBLE ELSE 0 END) AS outlier_pct, avg(abs(r / nullif(actual, 0))) * 100 AS mape FROM r GROUP BY state, date)
    SELECT *, longest_run >= 8 AS systematic, CASE WHEN mape < 1.5 THEN 'A' WHEN mape < 3 THEN 'B' WHEN mape < 5 THEN 'C' ELSE 'D' END AS grade,
      CASE WHEN mean > 10 THEN 'Under-forecasting' WHEN mean < -10 THEN 'Over-forecasting' ELSE 'Well-centered' END AS bias FROM a JOIN l USING (state, date) JOIN w USING (state, date)""")
def _(v):
    return ds.residual_diagnostics(v.pair)


@query("d45_correlation_matrix_view", "state a b rho:f", f"""
    WITH m AS (SELECT state, split_part(pair, '|', 1) AS a, split_part(pair, '|', 2) AS b, rho FROM ({spearman('v_frame', 'state', {f"{a}|{b}": (a, b) for i, a in enumerate(_FCOLS[:3]) for b in _FCOLS[:3][i:]})}))
    SELECT * FROM m UNION ALL SELECT state, b, a, rho FROM m WHERE a <> b""")
def _(v):
    return ds.correlation_matrix(v.frame, _FCOLS[:3])


@query("d46_distinct_counts", "state n_date:i n_block:i", "SELECT state, count(DISTINCT date) AS n_date, count(DISTINCT block) AS n_block FROM v_load GROUP BY state")
def _(v):
    return ds.distinct_counts(v.load, ["date", "block"])


@query("d47_grouping_sets", "state dow:i n:i mean:f", "SELECT state, dow, count(*) AS n, avg(load) AS mean FROM v_cal GROUP BY GROUPING SETS ((state, dow), (state), (dow), ())")
def _(v):
    return v.cal.groupingSets([["state", "dow"], ["state"], ["dow"], []], "state", "dow").agg(F.count(F.lit(1)).alias("n"), F.avg("load").alias("mean"))


@query("d47_rollup_cube", "state is_weekend:i is_holiday:i n:i", "SELECT state, is_weekend, is_holiday, count(*) AS n FROM v_cal GROUP BY CUBE (state, is_weekend, is_holiday)")
def _(v):
    return v.cal.cube("state", "is_weekend", "is_holiday").agg(F.count(F.lit(1)).alias("n"))


_IP = {"heat_index_effect": ("load", "hi"), "rain_temperature_interaction": ("load", "rt"), "weekend_weather_interaction": ("load", "wt")}


@query("d49_interaction_kpis", "state " + " ".join(f"{k}:f" for k in _IP), f"""
    WITH x AS (SELECT *, round(temperature + 0.33::DOUBLE * humidity - 4, 6) AS hi, round(precipitation * temperature, 6) AS rt, temperature * is_weekend AS wt FROM v_frame)
    {spearman_wide('x', 'state', _IP)}""")
def _(v):
    x = ds.interaction_pairs(v.frame).withColumns({"hi": F.round("_hi", 6), "rt": F.round("_rt", 6), "wt": F.col("_wt")})
    return rank_corr_wide(x, ["state"], _IP)


@query("d49_max_ramp", "state date max_ramp:f max_ramp_block:i", """
    WITH x AS (SELECT *, abs(load - max(load) OVER (PARTITION BY state, date ORDER BY block RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS r FROM v_load)
    SELECT state, date, coalesce(max(r), 0) AS max_ramp, arg_max(block, (r, -block)) FILTER (WHERE r IS NOT NULL) AS max_ramp_block FROM x GROUP BY state, date""")
def _(v):
    return ds.max_ramp(v.load)


@query("d50_last_week_correlations", "state pair rho:f n:i", f"""
    WITH x AS (SELECT f.* FROM v_frame f JOIN (SELECT state, date, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS rn FROM v_frame GROUP BY state, date) d USING (state, date) WHERE rn <= 7)
    {spearman('x', 'state', {c: ('load', c) for c in ('temperature', 'humidity', 'precipitation')})}""")
def _(v):
    return rank_corr(ds.last_dates(v.frame, 7), ["state"], {c: ("load", c) for c in ("temperature", "humidity", "precipitation")})


@query("d51_module_bundle", "state view metric value:f", f"""
    WITH a AS (SELECT state, avg(load) AS average, max(load) AS peak, stddev_samp(load) AS volatility, CAST(count(load) AS DOUBLE) AS points FROM v_frame GROUP BY state),
    q AS (SELECT state, quantile_cont(load, 0.9) AS p FROM v_frame GROUP BY state),
    b AS (SELECT state, avg(load) AS average_load, max(load) AS peak_load, min(load) AS minimum_load, sum(load) AS energy, avg(load) / max(load) AS load_factor,
      CAST(count(*) FILTER (WHERE load >= p) AS DOUBLE) AS peak_points, avg(CASE WHEN load >= p THEN 100.0::DOUBLE ELSE 0 END) AS time_above_p90_pct FROM v_frame JOIN q USING (state) GROUP BY state),
    c AS (SELECT state, arg_max(hour, (m, -hour)) AS ph FROM (SELECT state, hour, avg(load) AS m FROM v_frame GROUP BY ALL) GROUP BY state),
    k AS (SELECT state, load, row_number() OVER (PARTITION BY state ORDER BY load DESC, date, block) AS rn, count(*) OVER (PARTITION BY state) AS n FROM v_frame),
    d AS (SELECT state, max(load) AS peak_load, max(load) FILTER (WHERE rn = floor(n * 0.05::DOUBLE) + 1) AS p95_load FROM k GROUP BY state)
    SELECT state, 'standard_kpis' AS view, metric, value FROM (UNPIVOT a ON average, peak, volatility, points INTO NAME metric VALUE value)
    UNION ALL SELECT state, 'load_state', metric, value FROM (UNPIVOT b ON average_load, peak_load, minimum_load, energy, load_factor, peak_points, time_above_p90_pct INTO NAME metric VALUE value)
    UNION ALL SELECT state, 'duration', metric, value FROM (UNPIVOT d ON peak_load, p95_load INTO NAME metric VALUE value)""")
def _(v):
    return view_registry.dispatch(v.frame, ["standard_kpis", "load_state", "duration"])


@query("d52_weather_by_location", "state date location temperature:f", "SELECT state, date, location, avg(temperature) AS temperature FROM v_wloc WHERE date = DATE '2024-01-15' GROUP BY ALL")
def _(v):
    return v.wloc.where(F.col("date") == F.lit("2024-01-15").cast("date")).groupBy("state", "date", "location").agg(F.avg("temperature").alias("temperature"))
