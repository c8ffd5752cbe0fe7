"""2.D aggregations and KPIs (first half: engine views and tabs)."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import slope, spearman, spearman_wide
from quarterhour.operators import kpis


def pct(a, b):
    return f"(({a}) - ({b})) / nullif({b}, 0) * 100"


def fa(cond, v="load"):
    """avg with a filter"""
    return f"avg({v}) FILTER (WHERE {cond})"


@query("d1_standard_kpis", "state average:f peak:f volatility:f points:i", """
    SELECT state, avg(load) AS average, max(load) AS peak, stddev_samp(load) AS volatility, count(load) AS points FROM v_load GROUP BY state""")
def _(v):
    return kpis.standard(v.load)


@query("d2_kpis_on_hourly_means", "state average:f peak:f volatility:f points:i", """
    SELECT state, avg(x) AS average, max(x) AS peak, stddev_samp(x) AS volatility, count(x) AS points FROM (SELECT state, date, hour, avg(load) AS x FROM v_cal GROUP BY ALL) GROUP BY state""")
def _(v):
    return kpis.on_hourly_means(v.cal)


@query("d3_hour_of_day_kpis", "state hour:i average:f peak:f volatility:f points:i", """
    SELECT state, hour, avg(load) AS average, max(load) AS peak, stddev_samp(load) AS volatility, count(load) AS points FROM v_cal GROUP BY state, hour""")
def _(v):
    return kpis.standard(v.cal, keys=["state", "hour"])


@query("d4_block_intelligence", "state peak_load_block:i most_volatile_block:i avg_volatility:f", """
    WITH p AS (SELECT state, block, avg(load) AS m, stddev_samp(load) AS s FROM v_load GROUP BY state, block)
    SELECT state, arg_max(block, (m, -block)) AS peak_load_block, arg_max(block, (s, -block)) FILTER (WHERE s IS NOT NULL) AS most_volatile_block, avg(s) AS avg_volatility FROM p GROUP BY state""")
def _(v):
    return kpis.block_summary(v.load)


@query("d5_fair_weather_base", "state season is_weekend:i block:i base_load_mw:f", """
    WITH f AS (SELECT *, 'Winter' AS season, temperature BETWEEN 15 AND 22 AND precipitation <= 0.1 AND humidity BETWEEN 30 AND 70 AS strict, temperature BETWEEN 15 AND 25 AS loose FROM v_frame),
    a AS (SELECT *, bool_or(strict) OVER (PARTITION BY state) AS any_strict FROM f)
    SELECT state, season, is_weekend, block, median(load) AS base_load_mw FROM a WHERE CASE WHEN any_strict THEN strict ELSE loose END GROUP BY state, season, is_weekend, block""")
def _(v):
    from quarterhour.operators.features import season4
    return kpis.fair_weather_base(v.frame.withColumn("season", season4("month")))


_DAY = "d AS (SELECT state, date, avg(load) AS a, max(load) AS mx, min(load) AS mn, sum(load) AS total FROM v_frame GROUP BY state, date)"


@query("d6_days_over_previous", "state date avg:f delta:f delta_pct:f rank:i", f"""
    WITH {_DAY}, l AS (SELECT *, a - lag(a) OVER (PARTITION BY state ORDER BY date) AS delta, lag(a) OVER (PARTITION BY state ORDER BY date) AS p FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY delta DESC, date) AS rank FROM l WHERE delta > 0)
    SELECT state, date, a AS avg, delta, delta / p * 100 AS delta_pct, rank FROM r WHERE rank <= 20""")
def _(v):
    return kpis.over_previous_day(v.load)


@query("d7_days_over_previous_with_rain", "state days_exceeding:i days_below:i total_days:i avg_increase:f max_increase:f max_decrease:f wet_exceed_rate:f dry_exceed_rate:f", """
    WITH d AS (SELECT state, date, avg(load) AS a, sum(precipitation) AS rain FROM v_frame GROUP BY state, date),
    l AS (SELECT *, a - lag(a) OVER (PARTITION BY state ORDER BY date) AS delta, coalesce(rain > 0.1, false) AS wet FROM d)
    SELECT state, count(*) FILTER (WHERE delta > 0) AS days_exceeding, count(*) FILTER (WHERE delta < 0) AS days_below, count(delta) AS total_days, avg(delta) FILTER (WHERE delta > 0) AS avg_increase,
      max(delta) AS max_increase, min(delta) AS max_decrease, avg(CASE WHEN delta > 0 THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE wet) AS wet_exceed_rate,
      avg(CASE WHEN delta > 0 THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE NOT wet) AS dry_exceed_rate FROM l GROUP BY state""")
def _(v):
    return kpis.over_previous_day_kpis(v.frame)


@query("d8_weekly_pattern", "state dow:i block:i mean:f", "SELECT state, dow, block, avg(load) AS mean FROM v_cal GROUP BY state, dow, block")
def _(v):
    return kpis.weekly_pattern(v.cal)


@query("d8_weekly_pattern_wide", "state block:i " + " ".join(f"dow_{d}:f" for d in range(7)),
       "SELECT state, block, " + ", ".join(f"avg(load) FILTER (WHERE dow = {d}) AS dow_{d}" for d in range(7)) + " FROM v_cal GROUP BY state, block")
def _(v):
    return kpis.weekly_pattern(v.cal, wide=True)


@query("d9_hourly_cycle", "state peak_hour:i valley_hour:i peak_mean:f valley_mean:f", """
    WITH h AS (SELECT state, hour, avg(load) AS m FROM v_cal GROUP BY state, hour)
    SELECT state, arg_max(hour, (m, -hour)) AS peak_hour, arg_min(hour, (m, hour)) AS valley_hour, max(m) AS peak_mean, min(m) AS valley_mean FROM h GROUP BY state""")
def _(v):
    return kpis.hourly_cycle(v.cal)


@query("d10_load_state", "state average_load:f peak_load:f minimum_load:f energy:f load_factor:f peak_points:i time_above_p90_pct:f", """
    WITH q AS (SELECT state, quantile_cont(load, 0.9) AS p FROM v_load GROUP BY state)
    SELECT state, avg(load) AS average_load, max(load) AS peak_load, min(load) AS minimum_load, sum(load) AS energy, avg(load) / max(load) AS load_factor,
      count(*) FILTER (WHERE load >= p) AS peak_points, avg(CASE WHEN load >= p THEN 100.0::DOUBLE ELSE 0 END) AS time_above_p90_pct FROM v_load JOIN q USING (state) GROUP BY state""")
def _(v):
    return kpis.load_state(v.load)


@query("d11_shape_kpis", "state curve_flatness:f peak_sharpness:f valley_depth:f spread_p95_p05:f shoulder_strength:f duck_severity:f symmetry:f", """
    WITH b AS (SELECT state, avg(load) AS a, stddev_samp(load) / avg(load) AS curve_flatness, max(load) / avg(load) AS peak_sharpness, (max(load) - min(load)) / max(load) AS valley_depth,
        quantile_cont(load, 0.95) - quantile_cont(load, 0.05) AS spread_p95_p05 FROM v_cal GROUP BY state),
    h AS (SELECT state, hour, avg(load) AS m FROM v_cal GROUP BY state, hour), s AS (SELECT *, m - lag(m) OVER (PARTITION BY state ORDER BY hour) AS step FROM h),
    k AS (SELECT state, min(m) FILTER (WHERE hour BETWEEN 11 AND 15) AS v, max(m) FILTER (WHERE hour BETWEEN 18 AND 22) AS e, avg(m) FILTER (WHERE hour BETWEEN 7 AND 9) AS ms,
        avg(m) FILTER (WHERE hour BETWEEN 16 AND 18) AS es, avg(step) FILTER (WHERE hour BETWEEN 7 AND 9) AS sl, avg(step) FILTER (WHERE hour BETWEEN 17 AND 19) AS se FROM s GROUP BY state)
    SELECT *, (ms + es) / 2 / a AS shoulder_strength, (e - v) / a AS duck_severity, 1 - abs(sl - se) / (abs(sl) + abs(se) + 1e-6) AS symmetry FROM b JOIN k USING (state)""")
def _(v):
    return kpis.shape(v.cal)


@query("d12_ramp_kpis", "state morning_ramp:f evening_ramp:f max_ramp:f ramp_volatility:f min_ramp:f sustained_ramps:i", """
    WITH q AS (SELECT state, quantile_cont(abs(ramp), 0.9) AS q FROM v_eda GROUP BY state)
    SELECT state, median(ramp) FILTER (WHERE hour BETWEEN 6 AND 10) AS morning_ramp, median(ramp) FILTER (WHERE hour BETWEEN 16 AND 20) AS evening_ramp, max(ramp) AS max_ramp,
      stddev_samp(ramp) AS ramp_volatility, min(ramp) AS min_ramp, count(*) FILTER (WHERE abs(ramp) > q) AS sustained_ramps FROM v_eda JOIN q USING (state) GROUP BY state""")
def _(v):
    return kpis.ramps(v.ser_lazy)


_PEAKS = """pk AS (SELECT state, date, arg_max(block, (load, -block)) AS pb, max(load) AS mx, min(load) AS mn, max(is_weekend) AS we FROM v_cal GROUP BY state, date)"""


@query("d13_temporal_kpis", "state peak_block_frequency:i peak_drift:f weekend_shift:f", f"""
    WITH {_PEAKS}, m AS (SELECT state, max(n) AS f FROM (SELECT state, pb, count(*) AS n FROM pk GROUP BY state, pb) GROUP BY state), s AS (SELECT state, stddev_samp(pb) AS d FROM pk GROUP BY state),
    w AS (SELECT state, {fa('is_weekend = 1')} - {fa('is_weekend = 0')} AS w FROM v_cal GROUP BY state)
    SELECT state, f AS peak_block_frequency, d AS peak_drift, w AS weekend_shift FROM m JOIN s USING (state) JOIN w USING (state)""")
def _(v):
    return kpis.temporal(v.cal)


_STAB = f"""b AS (SELECT state, stddev_samp(load) / avg(load) AS relative_volatility, quantile_cont(load, 0.95) - quantile_cont(load, 0.05) AS bandwidth FROM v_eda GROUP BY state),
    r AS ({spearman_wide('v_eda', 'state', {'persistence_d1': ('d1', 'load'), 'persistence_d7': ('d7', 'load')})})"""


@query("d14_stability_kpis", "state relative_volatility:f persistence_d1:f persistence_d7:f bandwidth:f", f"WITH {_STAB} SELECT * FROM b JOIN r USING (state)")
def _(v):
    return kpis.stability(v.ser_lazy)


_WPAIRS = {f"{c}_sensitivity": ("load", c) for c in kpis.WEATHER_COLS} | {"heat_stress": ("load", "heat_index")}


@query("d15_weather_kpis", "state " + " ".join(f"{p}:f" for p in _WPAIRS) + " humidity_amplification:f rain_suppression_mw:f", f"""
    WITH r AS ({spearman_wide('v_eda', 'state', _WPAIRS)}), q AS (SELECT state, quantile_cont(humidity, 0.25) AS q1, quantile_cont(humidity, 0.75) AS q3 FROM v_eda GROUP BY state),
    a AS (SELECT state, {fa('humidity >= q3')} / {fa('humidity <= q1')} AS humidity_amplification, {fa('precipitation <= 0.1')} - {fa('precipitation > 0.1')} AS rain_suppression_mw
      FROM v_eda JOIN q USING (state) GROUP BY state) SELECT * FROM r JOIN a USING (state)""")
def _(v):
    return kpis.weather(v.ser)


_RISK = """k AS (SELECT state, avg(CASE WHEN load > p90 THEN 1.0::DOUBLE ELSE 0 END) AS peak_probability, avg(CASE WHEN load > p99 THEN 1.0::DOUBLE ELSE 0 END) AS extreme_frequency,
      quantile_cont(abs(ramp), 0.95) AS ramp_stress, max(p99) AS tail_p99, avg(CASE WHEN load > 400 THEN 1.0::DOUBLE ELSE 0 END) AS capacity_breach
      FROM v_eda JOIN (SELECT state, quantile_cont(load, 0.9) AS p90, quantile_cont(load, 0.99) AS p99 FROM v_eda GROUP BY state) USING (state) GROUP BY state)"""


@query("d16_risk_kpis", "state peak_probability:f extreme_frequency:f ramp_stress:f tail_p99:f capacity_breach:f", f"WITH {_RISK} SELECT * FROM k")
def _(v):
    return kpis.risk(v.ser_lazy, capacity=400.0)


@query("d17_composite_indices", "state grid_stress:f weather_dependency:f forecast_confidence:f dispatch_difficulty:f", f"""
    WITH {_STAB}, {_RISK}, t AS (SELECT state, {slope('load', 'temperature')} AS s, avg(abs(load - d7) / nullif(load, 0)) * 100 AS m FROM v_eda GROUP BY state)
    SELECT state, least(100, relative_volatility * 100 + extreme_frequency * 100) AS grid_stress, least(100, abs(s) * 100) AS weather_dependency,
      least(100, CASE WHEN m > 0 THEN greatest(0, 100 - m) ELSE 0 END) AS forecast_confidence, least(100, relative_volatility * 50 + ramp_stress * 2) AS dispatch_difficulty
    FROM b JOIN k USING (state) JOIN t USING (state)""")
def _(v):
    return kpis.composites(v.ser)


@query("d18_distribution", "state mean:f median:f skewness:f kurtosis:f p95:f p05:f mode:f", """
    WITH b AS (SELECT state, avg(load) AS mean, median(load) AS median, skewness(load) AS skewness, kurtosis(load) AS kurtosis, quantile_cont(load, 0.95) AS p95, quantile_cont(load, 0.05) AS p05 FROM v_load GROUP BY state),
    c AS (SELECT state, load, count(*) AS n FROM v_load GROUP BY state, load), m AS (SELECT state, arg_max(load, (n, -load)) AS mode FROM c GROUP BY state) SELECT * FROM b JOIN m USING (state)""")
def _(v):
    return kpis.distribution(v.load)


@query("d18_histogram", "state bin:i n:i", """
    WITH l AS (SELECT state, min(load) AS lo, max(load) AS hi FROM v_load GROUP BY state)
    SELECT state, least(50, CAST(floor((load - lo) / nullif((hi - lo) / 50, 0)) AS BIGINT) + 1) AS bin, count(*) AS n FROM v_load JOIN l USING (state) GROUP BY ALL""")
def _(v):
    from quarterhour.operators.select import equal_width_bins
    return equal_width_bins(v.load, "load", 50).groupBy("state", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("d19_boxplot", "state dow:i low:f q1:f median:f q3:f high:f mean:f peak_gap_pct:f", """
    WITH g AS (SELECT state, dow, min(load) AS low, quantile_cont(load, 0.25) AS q1, median(load) AS median, quantile_cont(load, 0.75) AS q3, max(load) AS high, avg(load) AS mean FROM v_cal GROUP BY state, dow)
    SELECT *, (max(mean) OVER w - min(mean) OVER w) / min(mean) OVER w * 100 AS peak_gap_pct FROM g WINDOW w AS (PARTITION BY state)""")
def _(v):
    return kpis.boxplot(v.cal)


@query("d20_load_duration_curve", "state rank:i load:f pct_time:f", """
    SELECT state, rn AS rank, load, (rn - 1) * 100.0::DOUBLE / (n - 1) AS pct_time FROM (
      SELECT state, load, row_number() OVER (PARTITION BY state ORDER BY load DESC, date, block) AS rn, count(*) OVER (PARTITION BY state) AS n FROM v_load)""")
def _(v):
    return kpis.duration_curve(v.load)


@query("d20_duration_p95", "state peak_load:f p95_load:f", """
    WITH c AS (SELECT state, load, row_number() OVER (PARTITION BY state ORDER BY load DESC, date, block) AS rn, count(*) OVER (PARTITION BY state) AS n FROM v_load)
    SELECT state, max(load) AS peak_load, max(load) FILTER (WHERE rn = floor(n * 0.05::DOUBLE) + 1) AS p95_load FROM c GROUP BY state""")
def _(v):
    return kpis.duration_p95(v.load)


@query("d21_ramp_rates", "state max_up_ramp:f max_down_ramp:f avg_abs_ramp:f", """
    SELECT state, max(ramp) * 4 AS max_up_ramp, min(ramp) * 4 AS max_down_ramp, avg(abs(ramp)) * 4 AS avg_abs_ramp FROM v_eda GROUP BY state""")
def _(v):
    return kpis.ramp_rates(v.ser_lazy)


@query("d22_year_over_year", "state year:i day_of_year:i mean:f", "SELECT state, year(date) AS year, dayofyear(date) AS day_of_year, avg(load) AS mean FROM v_daily GROUP BY ALL")
def _(v):
    return kpis.year_over_year(v.daily)


_CE = {f"{c}_{t}": c for c in ("temperature", "humidity", "precipitation") for t in ("weekday", "weekend")}
_CE_COLS = ", ".join(f"CASE WHEN is_weekend = {0 if n.endswith('day') and not n.endswith('weekend') else 1} THEN {c} END AS {n}" for n, c in _CE.items())


@query("d23_calendar_effects", "state weekday_avg:f weekend_avg:f weekend_effect_pct:f strongest_season " + " ".join(f"{n}:f" for n in _CE), f"""
    WITH p AS (SELECT state, {fa('is_weekend = 0', 'm')} AS weekday_avg, {fa('is_weekend = 1', 'm')} AS weekend_avg FROM
        (SELECT state, is_weekend, block, avg(load) AS m FROM v_eda GROUP BY ALL) GROUP BY state),
    s AS (SELECT state, arg_max(season, (m, season)) AS strongest_season FROM (SELECT state, season, avg(m) AS m FROM (SELECT state, season, is_weekend, avg(load) AS m FROM v_eda GROUP BY ALL) GROUP BY ALL) GROUP BY state),
    x AS (SELECT state, load, {_CE_COLS} FROM v_eda), r AS ({spearman_wide('x', 'state', {n: ('load', n) for n in _CE})})
    SELECT *, (weekend_avg - weekday_avg) / weekday_avg * 100 AS weekend_effect_pct FROM p JOIN s USING (state) JOIN r USING (state)""")
def _(v):
    return kpis.calendar_effect(v.ser)


@query("d23_season_table", "state season is_weekend:i mean:f std:f", """
    SELECT state, CASE WHEN month(date) IN (12,1,2) THEN 'Winter' WHEN month(date) <= 5 THEN 'Spring' WHEN month(date) <= 8 THEN 'Summer' ELSE 'Fall' END AS season,
      CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend, avg(load) AS mean, stddev_samp(load) AS std FROM v_daily GROUP BY ALL""")
def _(v):
    from quarterhour.operators.features import season4
    d = v.daily.withColumn("season", season4(F.month("date"))).withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))
    return kpis.season_table(d)


_BB = """t AS (SELECT *, ntile(3) OVER (PARTITION BY state ORDER BY temperature, date, block) AS tt FROM v_eda WHERE temperature IS NOT NULL),
    tb AS (SELECT state, block, avg(load) FILTER (WHERE tt = 1) AS temp_low, avg(load) FILTER (WHERE tt = 2) AS temp_medium, avg(load) FILTER (WHERE tt = 3) AS temp_high FROM t GROUP BY state, block),
    bb AS (SELECT state, block, avg(load) AS avg_load, stddev_samp(load) AS std_load, max(load) AS peak_load, max(load) / (avg(load) + 1e-6) AS peak_ratio,
      coalesce(avg(load) FILTER (WHERE is_weekend = 1) - avg(load) FILTER (WHERE is_weekend = 0), 0) AS weekend_delta FROM v_eda GROUP BY state, block)"""


@query("d24_behaviour_blocks", "state block:i avg_load:f std_load:f peak_load:f peak_ratio:f weekend_delta:f temp_low:f temp_medium:f temp_high:f", f"WITH {_BB} SELECT * FROM bb LEFT JOIN tb USING (state, block)")
def _(v):
    return kpis.behaviour_blocks(v.ser)


@query("d24_behaviour_kpis", "state peak_evening_probability:f average_ramp:f curve_flatness:f weekend_flattening:f holiday_suppression:f cooling_sensitivity:f block_volatility:f daily_curve_deviation:f peak_risk:f", f"""
    WITH {_BB}, {_PEAKS}, p AS (SELECT state, avg(CASE WHEN (pb - 1) // 4 BETWEEN 18 AND 22 THEN 1.0::DOUBLE ELSE 0 END) AS peak_evening_probability FROM pk GROUP BY state),
    b AS (SELECT state, avg(std_load) AS curve_flatness, avg(abs(weekend_delta)) AS weekend_flattening, avg(coalesce(std_load, 0)) AS block_volatility FROM bb GROUP BY state),
    r AS (SELECT state, avg(abs(ramp)) AS average_ramp, {fa('is_holiday = 1')} / ({fa('is_holiday = 0')} + 1e-6) AS holiday_suppression, avg(abs(baseline_dev)) AS daily_curve_deviation, avg(dev_score) AS peak_risk FROM v_eda GROUP BY state),
    c AS ({spearman_wide('v_eda', 'state', {'cooling_sensitivity': ('load', 'temperature')})})
    SELECT * FROM p JOIN b USING (state) JOIN r USING (state) JOIN c USING (state)""")
def _(v):
    return kpis.behaviour(v.ser)


@query("d25_tab_time", "state peak_evening_pct:f peak_load_daily:f peak_timing_stability:f valley_depth:f morning_ramp:f evening_ramp:f base_load_night:f intraday_volatility:f curve_flatness:f avg_load_per_block:f", f"""
    WITH {_PEAKS}, p AS (SELECT state, avg(CASE WHEN (pb - 1) // 4 BETWEEN 18 AND 22 THEN 100.0::DOUBLE ELSE 0 END) AS peak_evening_pct, avg(mx) AS peak_load_daily, coalesce(stddev_samp(pb), 0) AS peak_timing_stability,
      avg(mx - mn) / (avg(mx) + 1e-6) AS valley_depth FROM pk GROUP BY state),
    a AS (SELECT state, {fa('hour BETWEEN 7 AND 10', 'abs(ramp)')} AS morning_ramp, {fa('hour BETWEEN 18 AND 22', 'abs(ramp)')} AS evening_ramp, {fa('hour BETWEEN 1 AND 5')} AS base_load_night, avg(abs(ramp)) AS intraday_volatility FROM v_eda GROUP BY state),
    f AS (SELECT state, avg(s) AS curve_flatness FROM (SELECT state, date, stddev_samp(load) AS s FROM v_eda GROUP BY state, date) GROUP BY state),
    m AS (SELECT state, avg(x) AS avg_load_per_block FROM (SELECT state, block, avg(load) AS x FROM v_eda GROUP BY state, block) GROUP BY state)
    SELECT * FROM p JOIN a USING (state) JOIN f USING (state) JOIN m USING (state)""")
def _(v):
    return kpis.tab_time(v.ser)


@query("d26_tab_calendar", "state weekend_change_pct:f holiday_suppression:f pre_holiday_pct:f recovery_days:f bridge_pct:f long_weekend_pct:f peak_shift:f holiday_morning_pct:f holiday_evening_pct:f", f"""
    WITH {_PEAKS}, d AS (SELECT state, date, avg(load) AS v, max(is_weekend) AS we, max(is_holiday) AS ho, min(days_to_holiday) AS dt, max(bridge_day) AS br, max(long_weekend) AS lw FROM v_eda GROUP BY state, date),
    a AS (SELECT state, {fa('we = 1', 'v')} AS we, {fa('we = 0', 'v')} AS wd, {fa('ho = 1', 'v')} AS ho, {fa('ho = 0', 'v')} AS nh, {fa('dt = 1 AND ho = 0', 'v')} AS pre, {fa('br = 1', 'v')} AS br, {fa('lw = 1', 'v')} AS lw FROM d GROUP BY state),
    m AS (SELECT state, {fa('is_holiday = 1 AND hour BETWEEN 7 AND 10')} AS hm, {fa('is_holiday = 0 AND hour BETWEEN 7 AND 10')} AS nm, {fa('is_holiday = 1 AND hour BETWEEN 18 AND 22')} AS he,
      {fa('is_holiday = 0 AND hour BETWEEN 18 AND 22')} AS ne FROM v_eda GROUP BY state),
    p AS (SELECT state, {fa('we = 1', 'pb')} - {fa('we = 0', 'pb')} AS peak_shift FROM pk GROUP BY state),
    rl AS (SELECT h.state, h.date, min(f.date) - h.date AS lag FROM d h JOIN a USING (state) LEFT JOIN d f ON f.state = h.state AND f.date > h.date AND f.v >= 0.95::DOUBLE * a.nh WHERE h.ho = 1 GROUP BY h.state, h.date),
    r AS (SELECT state, avg(lag) AS rd FROM rl GROUP BY state)
    SELECT a.state, {pct('we', 'wd')} AS weekend_change_pct, ho / nh AS holiday_suppression, {pct('pre', 'nh')} AS pre_holiday_pct, coalesce(rd, 0) AS recovery_days, {pct('br', 'nh')} AS bridge_pct, {pct('lw', 'we')} AS long_weekend_pct,
      peak_shift, {pct('hm', 'nm')} AS holiday_morning_pct, {pct('he', 'ne')} AS holiday_evening_pct FROM a JOIN m USING (state) JOIN p USING (state) LEFT JOIN r USING (state)""")
def _(v):
    return kpis.tab_calendar(v.ser, v.hol)


@query("d27_tab_weather", "state temp_sensitivity:f cooling_pct:f heating_pct:f humidity_amplification:f rain_day_pct:f rain_evening_pct:f heat_stress:f peak_expansion_pct:f seasonal_elasticity:f", f"""
    WITH q AS (SELECT state, quantile_cont(temperature, 0.8) AS q8, quantile_cont(temperature, 0.5) AS q5 FROM v_eda GROUP BY state),
    a AS (SELECT state, {slope('load', 'temperature')} AS temp_sensitivity, {fa('cooling_degree > 0')} AS cool, {fa('cooling_degree = 0')} AS heat, {fa('humidity >= 75')} / {fa('humidity < 75')} AS humidity_amplification,
      {fa('rain_proxy = 1 AND hour BETWEEN 9 AND 17')} AS rd, {fa('rain_proxy = 0 AND hour BETWEEN 9 AND 17')} AS nd, {fa('rain_proxy = 1 AND hour BETWEEN 18 AND 22')} AS re, {fa('rain_proxy = 0 AND hour BETWEEN 18 AND 22')} AS ne,
      max(load) FILTER (WHERE temperature >= q8) AS hot, max(load) FILTER (WHERE temperature <= q5) AS normal FROM v_eda JOIN q USING (state) GROUP BY state),
    r AS ({spearman_wide('v_eda', 'state', {'heat_stress': ('load', 'heat_index')})}),
    e AS (SELECT state, avg(abs(rho)) AS seasonal_elasticity FROM ({spearman('v_eda', 'state, season', {'r': ('temperature', 'load')})}) GROUP BY state)
    SELECT a.state, temp_sensitivity, {pct('cool', 'heat')} AS cooling_pct, {pct('heat', 'cool')} AS heating_pct, humidity_amplification, {pct('rd', 'nd')} AS rain_day_pct, {pct('re', 'ne')} AS rain_evening_pct, heat_stress,
      {pct('hot', 'normal')} AS peak_expansion_pct, seasonal_elasticity FROM a JOIN r USING (state) JOIN e USING (state)""")
def _(v):
    return kpis.tab_weather(v.ser)


@query("d28_tab_memory", "state same_block_persistence:f weekly_recurrence:f rolling_dependency:f load_inertia:f base_load_stability:f weekly_reliability:f", f"""
    WITH e AS (SELECT * REPLACE (round(roll7_block, 6) AS roll7_block) FROM v_eda), r AS ({spearman_wide('e', 'state', {'same_block_persistence': ('d1', 'load'), 'weekly_recurrence': ('d7', 'load'), 'rolling_dependency': ('roll7_block', 'load')})}),
    a AS (SELECT state, stddev_samp(load) / (avg(abs(ramp)) + 1e-6) AS load_inertia, stddev_samp(load) FILTER (WHERE hour BETWEEN 1 AND 5) AS base_load_stability FROM v_eda GROUP BY state),
    w AS (SELECT state, avg(s) AS weekly_reliability FROM (SELECT state, dow, stddev_samp(load) AS s FROM v_eda GROUP BY state, dow) GROUP BY state)
    SELECT * FROM r JOIN a USING (state) JOIN w USING (state)""")
def _(v):
    return kpis.tab_memory(v.ser.withColumn("roll7_block", F.round("roll7_block", 6)))


@query("d29_tab_trend", "state dod_change_pct:f wow_change_pct:f peak_growth:f trend_strength:f trend_persistence_days:f acceleration:f regime_shift:f momentum_stability:f", f"""
    WITH {_DAY}, x AS (SELECT *, row_number() OVER w AS i, (a / nullif(lag(a) OVER w, 0) - 1) * 100 AS dod, (a / nullif(lag(a, 7) OVER w, 0) - 1) * 100 AS wow,
        avg(a) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll FROM d WINDOW w AS (PARTITION BY state ORDER BY date)),
    y AS (SELECT *, abs(dod - lag(dod) OVER (PARTITION BY state ORDER BY date)) AS acc, coalesce(dod > 0, false) AS up, stddev_samp(dod) OVER (PARTITION BY state) AS s FROM x),
    g AS (SELECT *, sum(CASE WHEN up = pu THEN 0 ELSE 1 END) OVER (PARTITION BY state ORDER BY date) AS run FROM (SELECT *, lag(up) OVER (PARTITION BY state ORDER BY date) AS pu FROM y)),
    rn AS (SELECT state, avg(n) AS trend_persistence_days FROM (SELECT state, run, count(*) FILTER (WHERE up) AS n FROM g GROUP BY state, run) GROUP BY state),
    r AS ({spearman_wide('y', 'state', {'trend_strength': ('i', 'roll')})}),
    k AS (SELECT state, avg(dod) AS dod_change_pct, avg(wow) AS wow_change_pct, {slope('mx', 'i')} AS peak_growth, avg(acc) AS acceleration, avg(CASE WHEN abs(dod) > 2 * s THEN 1.0::DOUBLE ELSE 0 END) AS regime_shift,
      1 / (1 + max(s)) AS momentum_stability FROM y GROUP BY state)
    SELECT * FROM k JOIN rn USING (state) JOIN r USING (state)""")
def _(v):
    return kpis.tab_trend(v.load)


@query("d30_tab_interaction", "state peak_temp_amplification:f weekend_heat:f holiday_heat:f weather_peak_coincidence:f memory_weather:f interaction_strength:f", f"""
    WITH e AS (SELECT v_eda.*, coalesce(temperature >= q8, false) AS hot, d1 * temperature AS mw FROM v_eda JOIN (SELECT state, quantile_cont(temperature, 0.8) AS q8 FROM v_eda GROUP BY state) USING (state)),
    a AS (SELECT state, {fa('hot AND is_evening_peak = 1')} / avg(load) AS peak_temp_amplification, {fa('hot AND is_weekend = 1')} / {fa('hot AND is_weekend = 0')} AS weekend_heat,
      {fa('hot AND is_holiday = 1')} / {fa('hot AND is_holiday = 0')} AS holiday_heat, avg(CASE WHEN hot AND is_evening_peak = 1 THEN 1.0::DOUBLE ELSE 0 END) AS weather_peak_coincidence FROM e GROUP BY state),
    r AS ({spearman_wide('e', 'state', {'memory_weather': ('mw', 'load'), 'ra': ('temp_x_peak', 'load'), 'rb': ('weather_x_load', 'load')})})
    SELECT *, (abs(ra) + abs(rb)) / 2 AS interaction_strength FROM a JOIN r USING (state)""")
def _(v):
    return kpis.tab_interaction(v.ser)


@query("d31_tab_baseline", "state baseline_error_pct:f seasonal_drift:f baseline_stability:f peak_timing_offset:f baseline_peak_deviation:f daily_energy_deviation_pct:f", f"""
    WITH {_PEAKS}, {_DAY}, bp AS (SELECT state, arg_max(block, (m, -block)) AS pb0, max(m) AS pm, avg(m) AS am FROM (SELECT state, block, avg(load) AS m FROM v_eda GROUP BY state, block) GROUP BY state),
    p AS (SELECT state, avg(abs(pb - pb0)) AS peak_timing_offset, avg(mx - pm) AS baseline_peak_deviation FROM pk JOIN bp USING (state) GROUP BY state),
    e AS (SELECT state, (avg(a) - max(am)) / max(am) * 100 AS daily_energy_deviation_pct FROM d JOIN bp USING (state) GROUP BY state),
    x AS (SELECT state, avg(abs(baseline_dev)) / (avg(load) + 1e-6) * 100 AS baseline_error_pct, stddev_samp(seasonal_profile) AS seasonal_drift, stddev_samp(baseline_dev) AS baseline_stability FROM v_eda GROUP BY state)
    SELECT * FROM x JOIN p USING (state) JOIN e USING (state)""")
def _(v):
    return kpis.tab_baseline(v.ser)


@query("d32_tab_stability", "state peak_volatility:f block_risk:f ramp_stress:f curve_distortion:f extreme_frequency:f dispatch_risk:f load_uncertainty:f anomaly_days:i", f"""
    WITH {_DAY}, c AS (SELECT *, (a / nullif(lag(a) OVER (PARTITION BY state ORDER BY date), 0) - 1) * 100 AS c FROM d), n AS (SELECT state, count(*) FILTER (WHERE abs(c) > 2 * s) AS anomaly_days FROM
        (SELECT *, stddev_samp(c) OVER (PARTITION BY state) AS s FROM c) GROUP BY state),
    x AS (SELECT state, avg(block_std) AS peak_volatility, avg(dev_score) AS block_risk, quantile_cont(abs(ramp), 0.95) AS ramp_stress, avg(abs(baseline_dev)) AS curve_distortion,
      avg(CASE WHEN load > p99 THEN 1.0::DOUBLE ELSE 0 END) AS extreme_frequency, avg(peak_volatility) AS dispatch_risk, avg(load_roll_7d_std) AS load_uncertainty
      FROM v_eda JOIN (SELECT state, quantile_cont(load, 0.99) AS p99 FROM v_eda GROUP BY state) USING (state) GROUP BY state)
    SELECT * FROM x JOIN n USING (state)""")
def _(v):
    return kpis.tab_stability(v.ser)


@query("d33_tab_executive", "state peak_range_low:f peak_range_high:f system_stability:f forecast_readiness:f operational_risk:f holiday_impact_pct:f weather_sensitivity:f growth_rate:f", f"""
    WITH r AS ({spearman_wide('v_eda', 'state', {'weather_sensitivity': ('temperature', 'load')})}),
    m AS (SELECT state, date_trunc('month', date) AS mo, avg(load) AS v FROM v_eda GROUP BY ALL), mi AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY mo) AS i FROM m),
    g AS (SELECT state, coalesce({slope('v', 'i')}, 0) AS growth_rate FROM mi GROUP BY state),
    x AS (SELECT state, quantile_cont(load, 0.9) AS peak_range_low, quantile_cont(load, 0.99) AS peak_range_high, 1 / (1 + stddev_samp(load)) AS system_stability, 1 / (1 + avg(abs(baseline_dev))) AS forecast_readiness,
      avg(peak_volatility) AS operational_risk, {pct(fa('is_holiday = 1'), fa('is_holiday = 0'))} AS holiday_impact_pct FROM v_eda GROUP BY state)
    SELECT * FROM x JOIN r USING (state) JOIN g USING (state)""")
def _(v):
    return kpis.tab_executive(v.ser)


@query("d33_monthly_growth", "state growth_rate:f", f"""
    WITH m AS (SELECT state, date_trunc('month', date) AS mo, avg(load) AS v FROM v_daily GROUP BY ALL), mi AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY mo) AS i FROM m)
    SELECT state, coalesce({slope('v', 'i')}, 0) AS growth_rate FROM mi GROUP BY state""")
def _(v):
    return kpis.monthly_growth(v.daily)


@query("d34_weather_dashboard", "state max_temp:f min_temp:f total_precip:f avg_humidity:f", """
    SELECT state, max(temperature) AS max_temp, min(temperature) AS min_temp, sum(precipitation) AS total_precip, avg(humidity) AS avg_humidity FROM v_frame GROUP BY state""")
def _(v):
    return kpis.weather_dashboard(v.frame)
