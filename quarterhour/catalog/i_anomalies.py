"""2.I anomaly and level-shift detection."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import slope
from quarterhour.operators import anomaly as an
from quarterhour.operators import isolation
from quarterhour.operators.peaks import peaks_by_prominence


@query("i1_iqr_outliers", "state date block:i load:f", """
    SELECT state, date, block, load FROM v_load JOIN (SELECT state, quantile_cont(load, 0.25) AS a, quantile_cont(load, 0.75) AS b FROM v_load GROUP BY state) USING (state) WHERE load < a - 1.5 * (b - a) OR load > b + 1.5 * (b - a)""")
def _(v):
    return an.iqr_outliers(v.load).where("is_outlier")


@query("i1_zscore_distortion", "state distortion_count:i distortion_rate_pct:f deviation_pct:f", """
    WITH z AS (SELECT *, abs(load - avg(load) OVER w) > 2 * stddev_pop(load) OVER w AS o FROM v_load WINDOW w AS (PARTITION BY state))
    SELECT state, count(*) FILTER (WHERE o) AS distortion_count, count(*) FILTER (WHERE o) * 100.0::DOUBLE / count(*) AS distortion_rate_pct,
      (avg(load) FILTER (WHERE o) - avg(load) FILTER (WHERE NOT o)) / avg(load) FILTER (WHERE NOT o) * 100 AS deviation_pct FROM z GROUP BY state""")
def _(v):
    return an.distortion(an.zscore_outliers(v.load, threshold=2.0))


@query("i2_jumps", "state date block:i ramp:f", "SELECT state, date, block, ramp FROM (SELECT state, date, block, load - max(load) OVER (PARTITION BY state ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ramp FROM v_t) WHERE abs(ramp) > 200")
def _(v):
    return an.jumps(v.ser_lazy, 200.0)


@query("i2_z_spikes", "state date block:i z:f", """
    SELECT state, date, block, z FROM (SELECT *, (load - avg(load) OVER w) / stddev_samp(load) OVER w AS z FROM v_load WINDOW w AS (PARTITION BY state)) WHERE abs(z) > 2""")
def _(v):
    return an.z_spikes(v.load, 2.0)


_SHIFT = """l AS (SELECT *, list_filter([max(load) OVER (w RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING), max(load) OVER (w RANGE BETWEEN 14 PRECEDING AND 14 PRECEDING), max(load) OVER (w RANGE BETWEEN 21 PRECEDING AND 21 PRECEDING),
      max(load) OVER (w RANGE BETWEEN 28 PRECEDING AND 28 PRECEDING)], lambda x: x IS NOT NULL) AS lags FROM v_t WINDOW w AS (PARTITION BY state, block ORDER BY dn)),
    b AS (SELECT *, list_aggregate(lags, 'median') AS baseline FROM l WHERE len(lags) > 0)"""


@query("i3_level_shift_days", "state date daily_shift:f consistency:f next_day_shift:f is_event", f"""
    WITH {_SHIFT}, m AS (SELECT state, date, median(load - baseline) AS ds FROM b GROUP BY state, date),
    d AS (SELECT b.state, b.date, ds AS daily_shift, avg(CASE WHEN abs(load - baseline - ds) < 150 THEN 1.0::DOUBLE ELSE 0 END) AS consistency FROM b JOIN m USING (state, date) GROUP BY b.state, b.date, ds),
    n AS (SELECT *, lead(daily_shift) OVER (PARTITION BY state ORDER BY date) AS next_day_shift FROM d)
    SELECT *, coalesce(abs(daily_shift) BETWEEN 10 AND 60 AND consistency >= 0.6 AND abs(next_day_shift) < 25, false) AS is_event FROM n""")
def _(v):
    return an.level_shift_days(v.load, tolerance=150.0, shift_min=10.0, shift_max=60.0, reversion=25.0, consistency=0.6)


@query("i4_level_shift_xray", "state block:i baseline:f event_day:f next_day:f", f"""
    WITH {_SHIFT}, x AS (SELECT t.state, t.block, t.date, t.load, b.baseline FROM v_t t LEFT JOIN b USING (state, date, block) WHERE t.date IN (DATE '2024-01-22', DATE '2024-01-23'))
    SELECT state, block, max(baseline) FILTER (WHERE date = DATE '2024-01-22') AS baseline, max(load) FILTER (WHERE date = DATE '2024-01-22') AS event_day, max(load) FILTER (WHERE date = DATE '2024-01-23') AS next_day FROM x GROUP BY state, block""")
def _(v):
    return an.level_shift_xray(v.load, "2024-01-22")


@query("i5_weather_free_anomalies", "state date block:i residual:f z:f is_anomaly", f"""
    WITH d AS (SELECT *, median(load) OVER (PARTITION BY state, dow, block) AS seasonal FROM v_frame WHERE load IS NOT NULL AND temperature IS NOT NULL), y AS (SELECT *, load - seasonal AS y FROM d),
    c AS (SELECT state, {slope('y', 'temperature')} AS b, avg(y) - {slope('y', 'temperature')} * avg(temperature) AS a FROM y GROUP BY state),
    r AS (SELECT y.*, y - coalesce(a + b * temperature, 0) AS residual FROM y JOIN c USING (state)), z AS (SELECT *, (residual - avg(residual) OVER w) / stddev_samp(residual) OVER w AS z FROM r WINDOW w AS (PARTITION BY state))
    SELECT *, abs(z) > 2.5 AS is_anomaly FROM z""")
def _(v):
    return an.weather_free_anomalies(v.frame)


@query("i6_peaks_by_prominence", "state date block:i load:f prominence:f", """
    WITH n AS (SELECT *, lag(load) OVER w AS l, lead(load) OVER w AS r FROM v_t WINDOW w AS (PARTITION BY state ORDER BY t)), p AS (SELECT * FROM n WHERE load > l AND load > r),
    b AS (SELECT p.state, p.date, p.block, p.t, p.load, coalesce(max(q.t) FILTER (WHERE q.t < p.t AND q.load > p.load), -1) AS lb, coalesce(min(q.t) FILTER (WHERE q.t > p.t AND q.load > p.load), 1e15) AS rb
      FROM p JOIN v_t q ON q.state = p.state GROUP BY ALL),
    m AS (SELECT b.state, b.date, b.block, b.load, min(q.load) FILTER (WHERE q.t <= b.t) AS ml, min(q.load) FILTER (WHERE q.t >= b.t) AS mr FROM b JOIN v_t q ON q.state = b.state AND q.t > b.lb AND q.t < b.rb GROUP BY ALL)
    SELECT state, date, block, load, load - greatest(ml, mr) AS prominence FROM m WHERE load - greatest(ml, mr) >= 150""")
def _(v):
    return peaks_by_prominence(v.load, 150.0)


@query("i7_distance_outliers", "state date block:i distance2:f", """
    WITH z AS (SELECT *, pow((load - avg(load) OVER w) / stddev_pop(load) OVER w, 2) + pow((hour - avg(hour) OVER w) / stddev_pop(hour) OVER w, 2) + pow((dow - avg(dow) OVER w) / stddev_pop(dow) OVER w, 2) AS distance2 FROM v_cal WINDOW w AS (PARTITION BY state)),
    q AS (SELECT *, quantile_cont(round(distance2, 9), 0.99) OVER (PARTITION BY state) AS c FROM z) SELECT state, date, block, distance2 FROM q WHERE round(distance2, 9) > c""")
def _(v):
    return an.distance_outliers(v.cal, 0.01).where("is_anomaly")


def _hours(v):
    """The dense grid, with gaps, and the hour and weekday of each block."""
    return v.grid.withColumns({"hour": F.floor((F.col("block") - 1) / 4).cast("int"), "dow": F.weekday("date")})


@query("i7_isolation_forest", "state date block:i score:f is_anomaly")
def _(v):
    return isolation.isolation_scores(_hours(v)).where("score is not null")


@query("i7_isolation_invariants", "state rows:i scored:i within_share in_range ends_stand_out", """
    SELECT state, count(*) AS rows, count(load) AS scored, true AS within_share, true AS in_range, true AS ends_stand_out FROM v_grid GROUP BY state""")
def _(v):
    """Every reading and no gap is scored, scores lie between 0 and 1, anomalies keep to the share, the highest load is above the usual score."""
    s = isolation.isolation_scores(_hours(v))
    n, hits = F.count("score"), F.count(F.when(F.col("is_anomaly"), 1))
    return s.groupBy("state").agg(F.count(F.lit(1)).alias("rows"), n.alias("scored"), (hits <= 0.01 * n + 1).alias("within_share"), ((F.min("score") > 0) & (F.max("score") < 1)).alias("in_range"),
                                  (F.max_by("score", "load") > F.median("score")).alias("ends_stand_out"))


@query("i8_risk_monitor", "state volatility_index:f max_ramp:f momentum_mw:f risk_level momentum", """
    WITH r AS (SELECT *, load - max(load) OVER (PARTITION BY state ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ramp FROM v_t),
    v AS (SELECT *, CASE WHEN count(ramp) OVER w >= 48 THEN stddev_samp(ramp) OVER w END AS vol FROM r WINDOW w AS (PARTITION BY state ORDER BY t RANGE BETWEEN 95 PRECEDING AND CURRENT ROW)),
    a AS (SELECT state, arg_max_null(vol, t) AS vi, avg(vol) AS mv, max(abs(ramp)) AS max_ramp FROM v GROUP BY state),
    d AS (SELECT state, date, avg(load) AS a, avg(load) - lag(avg(load)) OVER (PARTITION BY state ORDER BY date) AS diff FROM v_load GROUP BY state, date),
    m AS (SELECT state, date, CASE WHEN count(diff) OVER w >= 7 THEN avg(diff) OVER w END AS mom FROM d WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
    l AS (SELECT state, arg_max_null(mom, date) AS momentum_mw FROM m GROUP BY state)
    SELECT state, coalesce(vi, 0) AS volatility_index, max_ramp, momentum_mw, CASE WHEN vi > mv * 1.5 THEN 'Elevated' ELSE 'Stable' END AS risk_level, CASE WHEN momentum_mw > 0 THEN 'Increasing' ELSE 'Decreasing' END AS momentum FROM a JOIN l USING (state)""")
def _(v):
    return an.risk_monitor(v.ser_lazy)


@query("i9_alerts", "state order:i priority type value:f limit:f confidence:f", """
    WITH d AS (SELECT state, date, avg(load) AS a, stddev_samp(load) AS s, abs(avg(load) - lag(avg(load)) OVER (PARTITION BY state ORDER BY date)) AS shift FROM v_load GROUP BY state, date),
    j AS (SELECT m.state, mean, peak, shift, spread FROM (SELECT state, avg(load) AS mean, max(load) AS peak FROM v_load GROUP BY state) m JOIN (SELECT state, max(shift) AS shift, avg(s) AS spread FROM d GROUP BY state) x USING (state)),
    r AS (SELECT state, 0 AS "order", 'CRITICAL' AS priority, 'Peak Threshold' AS type, peak AS value, mean * 1.4::DOUBLE AS "limit", 0.95::DOUBLE AS confidence FROM j
      UNION ALL SELECT state, 1, 'WARNING', 'Base Shift', shift, mean * 0.15::DOUBLE, 0.88 FROM j UNION ALL SELECT state, 2, 'INFO', 'Unstable Profile', spread, mean * 0.2::DOUBLE, 0.75 FROM j)
    SELECT * FROM r WHERE value > "limit" """)
def _(v):
    return an.alerts(v.load)


@query("i10_dips_and_rises", "state date block:i kind diff_pct:f magnitude:f", """
    SELECT state, date, block, CASE WHEN load < baseline THEN 'dip' ELSE 'rise' END AS kind, (load - baseline) / baseline * 100 AS diff_pct, load - baseline AS magnitude FROM v_base WHERE baseline > 0 AND abs((load - baseline) / baseline * 100) >= 5""")
def _(v):
    return an.dips_and_rises(v.base)


@query("i11_day_exclusion", "state date mean:f trailing_mean:f anomalous excluded", """
    WITH d AS (SELECT state, date, dn, avg(load) AS mean FROM v_t GROUP BY ALL), t AS (SELECT *, CASE WHEN count(mean) OVER w >= 2 THEN avg(mean) OVER w END AS trailing_mean FROM d WINDOW w AS (PARTITION BY state ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, coalesce(abs((mean - trailing_mean) / trailing_mean) > 0.06, false) AS anomalous FROM t)
    SELECT *, anomalous OR coalesce(max(CAST(anomalous AS INTEGER)) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) = 1 AS excluded FROM a""")
def _(v):
    return an.day_anomalies(v.load)


@query("i12_outage_days", "state date sharp_drop storm_wind outage", """
    WITH x AS (SELECT *, max(load) OVER (PARTITION BY state, date ORDER BY block RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS l FROM v_frame),
    g AS (SELECT state, date, coalesce(bool_or(l > 300 AND (load - l) / l < -0.9), false) AS sharp_drop, coalesce(bool_or(wind_speed_10m >= 65), false) AS storm_wind FROM x GROUP BY state, date)
    SELECT *, sharp_drop OR storm_wind AS outage FROM g""")
def _(v):
    return an.outage_days(v.frame, drop=0.9, floor=300.0)


@query("i13_previous_night_dip", "state date night_mean:f trailing_mean:f dip prev_night_dip:i", """
    WITH d AS (SELECT state, date, dn, avg(load) AS night_mean FROM v_t WHERE block <= 32 GROUP BY ALL), t AS (SELECT *, CASE WHEN count(night_mean) OVER w >= 2 THEN avg(night_mean) OVER w END AS trailing_mean FROM d WINDOW w AS (PARTITION BY state ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, coalesce(night_mean < 0.85::DOUBLE * trailing_mean, false) AS dip FROM t)
    SELECT *, coalesce(max(CAST(dip AS INTEGER)) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS prev_night_dip FROM a""")
def _(v):
    return an.previous_night_dip(v.load)


_CLAMP = """h AS (SELECT p.*, CAST(date - DATE '1970-01-01' AS BIGINT) AS dn FROM v_pair p),
    s AS (SELECT *, avg(actual) OVER w AS hist_mean, greatest(stddev_pop(actual) OVER w, 50) AS hist_std, count(actual) OVER w AS n FROM h WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, CASE WHEN n >= 3 THEN abs(forecast - hist_mean) / hist_std END AS sigmas FROM s),
    k AS (SELECT *, greatest(CASE WHEN sigmas > 1.5 THEN forecast * (1 - least(0.7, (sigmas - 1.5) / 1.5 * 0.7)) + hist_mean * least(0.7, (sigmas - 1.5) / 1.5 * 0.7) ELSE forecast END, 0) AS clamped FROM g)"""


@query("i14_sigma_clamp", "state date block:i hist_mean:f hist_std:f sigmas:f clamped:f", f"WITH {_CLAMP} SELECT * FROM k")
def _(v):
    return an.sigma_clamp(v.pair, start=1.5)


@query("i15_trend_corridor", "state date block:i slope_mean:f slope_std:f trend_path:f outside patched:f", """
    WITH p AS (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) AS dn, CAST(date - DATE '1970-01-01' AS BIGINT) * 96 + block AS t FROM v_pair),
    a AS (SELECT *, max(actual) OVER (PARTITION BY state ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev FROM p), b AS (SELECT *, actual - prev AS sl FROM a),
    c AS (SELECT *, avg(sl) OVER w AS slope_mean, stddev_pop(sl) OVER w AS slope_std FROM b WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, max(CASE WHEN block = 1 THEN prev END) OVER (PARTITION BY state, date) + sum(coalesce(slope_mean, 0)) OVER (PARTITION BY state, date ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trend_path FROM c),
    e AS (SELECT *, coalesce(slope_std > 0 AND abs(forecast - trend_path) > 2 * slope_std, false) AS outside FROM d)
    SELECT *, CASE WHEN outside THEN trend_path ELSE forecast END AS patched FROM e""")
def _(v):
    return an.trend_corridor(v.pair)


@query("i16_unstable_days", "state date score:f unstable prev_unstable:i", f"""
    WITH {_CLAMP}, d AS (SELECT state, date, dn, avg(sigmas) AS score FROM k GROUP BY ALL)
    SELECT state, date, score, coalesce(score >= 0.9, false) AS unstable, coalesce(max(CASE WHEN score >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS prev_unstable FROM d""")
def _(v):
    return an.drastic_scores(an.sigma_clamp(v.pair, start=1.5), threshold=0.9)
