"""2.K baselines and forecasts."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.f_features import _RD
from quarterhour.catalog.sqlparts import spearman_wide
from quarterhour.operators import baselines as bl
from quarterhour.operators import quantile_trees
from quarterhour.operators import similar_targets as targets
from quarterhour.operators import similarity as sim
from quarterhour.operators.calendar import holiday_flag
from quarterhour.operators.grid import day_lag
from quarterhour.plans import forecast as fc
from quarterhour.plans.design import chronological_split
from quarterhour.sources.stage import shared


@query("k1_seasonal_naive", "state date block:i load:f forecast:f", """
    SELECT g.*, l.load AS forecast FROM v_grid g LEFT JOIN v_load l ON l.state = g.state AND l.block = g.block AND l.date = g.date - 7""")
def _(v):
    return bl.seasonal_naive(v.grid)


@query("k2_recent_day", "state date block:i forecast:f", f"WITH {_RD.format(h=1)} SELECT state, date, block, recent_day_baseline AS forecast FROM rd")
def _(v):
    return bl.recent_day(v.grid, v.hol, 1)


_REF = f"""{_RD.format(h=1)}, rf AS (SELECT g.state, g.date, g.block, g.load, coalesce(rd.recent_day_baseline, a.load, b.load) AS point FROM v_grid g LEFT JOIN rd USING (state, date, block)
    LEFT JOIN v_load a ON a.state = g.state AND a.block = g.block AND a.date = g.date - 7 LEFT JOIN v_load b ON b.state = g.state AND b.block = g.block AND b.date = g.date - 1)"""


@query("k3_reference_baseline", "state date block:i load:f point:f", f"WITH {_REF} SELECT * FROM rf")
def _(v):
    return fc.reference(v.grid, v.hol, 1)


_BAND = f"""{_REF}, err AS (SELECT state, date, load / point - 1 AS r FROM rf WHERE load IS NOT NULL AND point IS NOT NULL AND point <> 0),
    bd AS (SELECT t.state, t.date, count(*) AS n, quantile_cont(r, 0.1) AS lo, quantile_cont(r, 0.9) AS hi FROM (SELECT DISTINCT state, date FROM rf) t JOIN err e ON e.state = t.state AND e.date BETWEEN t.date - 56 AND t.date - 1 GROUP BY ALL),
    bq AS (SELECT rf.*, CASE WHEN point IS NULL THEN NULL ELSE list_sort([point * (1 + CASE WHEN n >= 500 THEN lo ELSE -0.05 END), point, point * (1 + CASE WHEN n >= 500 THEN hi ELSE 0.05 END)]) END AS q FROM rf LEFT JOIN bd USING (state, date)),
    bnd AS (SELECT state, date, block, load, point, CASE WHEN q IS NOT NULL THEN greatest(q[1], 0) END AS p10, CASE WHEN q IS NOT NULL THEN greatest(q[2], 0) END AS p50, CASE WHEN q IS NOT NULL THEN greatest(q[3], 0) END AS p90 FROM bq)"""


@query("k4_relative_band", "state date block:i point:f p10:f p50:f p90:f", f"WITH {_BAND} SELECT * FROM bnd WHERE point IS NOT NULL")
def _(v):
    return bl.relative_band(fc.reference(v.grid, v.hol, 1), "point", min_rows=500).where("point is not null")


@query("k5_boosted_residual_quantiles", "state date block:i p10:f p50:f p90:f")
def _(v):
    return fc.boosted_quantiles(v.grid, v.frame, v.hol, validation_days=5)


def _trees(v):
    rows = fc.quantile_rows(v.grid, v.wmean, v.hol)
    return rows, *fc.quantile_forecast(rows, "2024-01-24", 5, rounds=6)


@query("k5_quantile_trees", "state date block:i p10:f p50:f p90:f")
def _(v):
    return _trees(v)[1]


@query("k5_quantile_targets", "state date block:i load:f reference:f fitted ordered", f"""
    WITH {_REF} SELECT state, date, block, load, point AS reference, true AS fitted, true AS ordered FROM rf WHERE point IS NOT NULL AND date >= DATE '2024-01-24'
      AND state IN (SELECT state FROM rf WHERE point IS NOT NULL AND load IS NOT NULL AND date <= DATE '2024-01-18')""")
def _(v):
    """Every target row of a region with training days has three quantiles in order, none below zero."""
    out = _trees(v)[1].where("p50 is not null")
    return out.select("*", F.col("p50").isNotNull().alias("fitted"), ((F.col("p10") >= 0) & (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))).alias("ordered"))


@query("k5_quantile_invariants", "state level:f rows:i starts_at_share no_worse_than_start", f"""
    WITH {_REF} SELECT state, level, count(*) AS rows, true AS starts_at_share, true AS no_worse_than_start FROM rf CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) l(level)
    WHERE point IS NOT NULL AND load IS NOT NULL AND date <= DATE '2024-01-18' GROUP BY ALL""")
def _(v):
    """Each model starts at its quantile of the training residuals, and no tree makes the training loss worse."""
    rows, _, model = _trees(v)
    train = rows.where("load is not null").where(F.col("date") <= F.lit("2024-01-18").cast("date"))
    fitted = quantile_trees.predict(train, model, ["state", "residual"])
    start = F.create_map(*[x for (s, q), a in model.start.items() for x in (F.lit(f"{s}/{q}"), F.lit(a))])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("level"), F.element_at(start, F.concat("state", F.lit(f"/{q}"))).alias("first"), F.get("quantiles", F.lit(q)).alias("last")) for q, a in enumerate(model.levels)]))
    e = fitted.select("state", "residual", each.alias("o")).select("state", "residual", "o.*")
    loss = lambda c: F.greatest(F.col("level") * (F.col("residual") - F.col(c)), (F.col("level") - 1) * (F.col("residual") - F.col(c)))
    n, below, upto = F.count(F.lit(1)), F.count(F.when(F.col("residual") < F.col("first"), 1)), F.count(F.when(F.col("residual") <= F.col("first"), 1))
    return e.groupBy("state", "level").agg(n.alias("rows"), ((below <= F.col("level") * n + 1) & (upto >= F.col("level") * n - 1)).alias("starts_at_share"), (F.sum(loss("last")) <= F.sum(loss("first")) + 1e-6).alias("no_worse_than_start"))


@query("k6_quantile_ordering", "state date block:i p10:f p50:f p90:f", """
    SELECT state, date, block, greatest(list_sort([forecast - 30, actual, forecast + 10])[1], 0) AS p10, greatest(list_sort([forecast - 30, actual, forecast + 10])[2], 0) AS p50, greatest(list_sort([forecast - 30, actual, forecast + 10])[3], 0) AS p90 FROM v_pair""")
def _(v):
    a, b, c = bl.ordered_quantiles(F.col("forecast") - 30, F.col("actual"), F.col("forecast") + 10)
    return v.pair.select("state", "date", "block", a.alias("p10"), b.alias("p50"), c.alias("p90"))


@query("k7_day_ahead_summary", "state date energy_mwh:f peak_mw:f peak_block:i min_mw:f min_block:i mean_band_mw:f max_ramp_mw:f max_ramp_block:i complete", f"""
    WITH {_BAND}, r AS (SELECT *, abs(p50 - lag(p50) OVER (PARTITION BY state, date ORDER BY block)) AS rp FROM bnd)
    SELECT state, date, sum(p50) * 0.25::DOUBLE AS energy_mwh, max(p50) AS peak_mw, arg_max(block, (p50, -block)) FILTER (WHERE p50 IS NOT NULL) AS peak_block, min(p50) AS min_mw, arg_min(block, (p50, block)) FILTER (WHERE p50 IS NOT NULL) AS min_block,
      avg(p90 - p10) AS mean_band_mw, max(rp) AS max_ramp_mw, arg_max(block, (rp, -block)) FILTER (WHERE rp IS NOT NULL) AS max_ramp_block, count(p50) = 96 AS complete FROM r GROUP BY state, date""")
def _(v):
    return fc.summary(bl.relative_band(fc.reference(v.grid, v.hol, 1), "point", min_rows=500))


@query("k7_day_ahead_drivers", "state date temp_weighted_max:f temp_p90_max:f hot_share_peak:f precip_total:f night_min_temp:f", """
    WITH g AS (SELECT state, date, block, sum(weight * temperature) / sum(weight) AS tw, quantile_cont(temperature, 0.9) AS p90, coalesce(sum(weight) FILTER (WHERE temperature >= 35), 0) / sum(weight) AS hs, sum(weight * precipitation) / sum(weight) AS pw
      FROM v_wloc JOIN v_dw USING (location) GROUP BY ALL)
    SELECT state, date, max(tw) AS temp_weighted_max, max(p90) AS temp_p90_max, max(hs) AS hot_share_peak, sum(pw) AS precip_total, min(tw) FILTER (WHERE block <= 24) AS night_min_temp FROM g GROUP BY state, date""")
def _(v):
    from quarterhour.operators.weather import state_weather
    return fc.drivers(state_weather(v.wloc, v.dw))


@query("k7_day_ahead_blocks", "state date block:i p10:f p50:f p90:f baseline:f actual:f time record_id", f"""
    WITH {_BAND}, i AS (SELECT state, date, substr(sha256(state || '|' || CAST(date AS VARCHAR) || '|1|recent_day|' || CAST(CAST(round(coalesce(sum(p50), 0) + 1e-6) AS BIGINT) AS VARCHAR)), 1, 12) AS record_id FROM bnd GROUP BY state, date)
    SELECT b.state, b.date, b.block, p10, p50, p90, point AS baseline, load AS actual, printf('%02d:%02d', (b.block - 1) // 4, ((b.block - 1) % 4) * 15) AS time, i.record_id FROM bnd b JOIN i USING (state, date)""")
def _(v):
    return fc.day_ahead(v.grid, v.hol, horizon=1, model="recent_day", min_rows=500)


@query("a24_forecast_export", "horizon date region block:i time baseline_mw:f forecast_mw:f actual_mw:f p10_mw:f p90_mw:f dod_load_delta_mw:f temp_delta_mw:f", f"""
    WITH {_BAND}, t AS (SELECT 'T+1' AS horizon, * FROM bnd UNION ALL SELECT 'T+2', g.state, g.date, g.block, g.load, l.load, l.load * 0.95::DOUBLE, l.load, l.load * 1.05::DOUBLE FROM v_grid g LEFT JOIN v_load l ON l.state = g.state AND l.block = g.block AND l.date = g.date - 2)
    SELECT horizon, t.date, t.state AS region, t.block, printf('%02d:%02d', (t.block - 1) // 4, ((t.block - 1) % 4) * 15) AS time, point AS baseline_mw, p50 AS forecast_mw, t.load AS actual_mw, p10 AS p10_mw, p90 AS p90_mw,
      a.load - b.load AS dod_load_delta_mw, (w.temperature - w.n_temp) * 8 AS temp_delta_mw
    FROM t LEFT JOIN v_load a ON a.state = t.state AND a.block = t.block AND a.date = t.date - 1 LEFT JOIN v_load b ON b.state = t.state AND b.block = t.block AND b.date = t.date - 2 LEFT JOIN v_base w ON w.state = t.state AND w.date = t.date AND w.block = t.block""")
def _(v):
    t1 = bl.relative_band(fc.reference(v.grid, v.hol, 1), "point", min_rows=500)
    t2 = v.grid.withColumn("point", day_lag("load", 2)).withColumns({"p10": F.col("point") * 0.95, "p50": F.col("point"), "p90": F.col("point") * 1.05})
    return fc.export_table(t1, t2, v.grid, v.base)


@query("k8_complete_prior_days", "state date block:i load:f", """
    WITH d AS (SELECT state, date, count(*) FILTER (WHERE load > 0) AS n FROM v_load WHERE date < DATE '2024-01-24' GROUP BY ALL), a AS (SELECT *, max(CASE WHEN n >= 92 THEN 1 ELSE 0 END) OVER (PARTITION BY state) AS anyc FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM a WHERE anyc = 0 OR n >= 92) SELECT l.* FROM v_load l JOIN r USING (state, date) WHERE r <= 5""")
def _(v):
    return bl.complete_prior_days(v.load, "2024-01-24", 5, min_blocks=92)


_W15 = "SELECT unnest(range(1, 16)) AS w"


@query("k9_best_window_for_date", "state window:i mape:f", f"""
    WITH h AS (SELECT state, block, w, avg(load) AS b FROM v_load CROSS JOIN ({_W15}) WHERE date < DATE '2024-01-25' AND DATE '2024-01-25' - date <= w GROUP BY ALL), a AS (SELECT * FROM v_load WHERE date = DATE '2024-01-25' AND load > 0)
    SELECT a.state, w AS "window", avg(abs(a.load - b) / a.load) * 100 AS mape FROM a JOIN h USING (state, block) GROUP BY a.state, w""")
def _(v):
    return bl.window_errors(v.load, "2024-01-25")


@query("k9_best_window_choice", "state best_window:i mape:f", f"""
    WITH h AS (SELECT state, block, w, avg(load) AS b FROM v_load CROSS JOIN ({_W15}) WHERE date < DATE '2024-01-25' AND DATE '2024-01-25' - date <= w GROUP BY ALL), a AS (SELECT * FROM v_load WHERE date = DATE '2024-01-25' AND load > 0),
    m AS (SELECT a.state, w, avg(abs(a.load - b) / a.load) * 100 AS mape FROM a JOIN h USING (state, block) GROUP BY a.state, w) SELECT state, arg_min(w, (mape, w)) AS best_window, min(mape) AS mape FROM m GROUP BY state""")
def _(v):
    return bl.best_window(bl.window_errors(v.load, "2024-01-25"))


_DW = f"""d AS (SELECT state, date, avg(load) AS v, avg(temperature) AS tm FROM v_frame GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date) AS i FROM d),
    e AS (SELECT a.state, w, a.i, a.v, a.tm, avg(b.v) AS b, avg(b.tm) AS t FROM o a CROSS JOIN ({_W15}) JOIN o b ON b.state = a.state AND b.i BETWEEN a.i - w AND a.i - 1 WHERE a.i > w GROUP BY ALL)"""


@query("k10_daily_window_scores", "state window:i mape:f stability:f score:f", f"""
    WITH {_DW} SELECT state, w AS "window", avg(abs(v - b) / v * 100) AS mape, stddev_pop(abs(v - b) / v * 100) AS stability, avg(abs(v - b) / v * 100) + 0.5::DOUBLE * stddev_pop(abs(v - b) / v * 100) AS score FROM e GROUP BY state, w""")
def _(v):
    return bl.daily_window_scores(v.load)


@query("k11_weather_window_scores", "state window:i mape:f temp_diff:f score:f", f"""
    WITH {_DW} SELECT state, w AS "window", avg(abs(v - b) / v) * 100 AS mape, avg(abs(tm - t)) AS temp_diff, avg(abs(v - b) / v) * 100 + 0.5::DOUBLE * coalesce(avg(abs(tm - t)), 0) AS score FROM e GROUP BY state, w""")
def _(v):
    return bl.weather_window_scores(v.frame)


@query("k12_adaptive_window", "state load_cv:f rainy_days:i window:i", """
    WITH d AS (SELECT state, date, avg(load) AS v, sum(precipitation) AS rain, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM v_frame GROUP BY state, date),
    s AS (SELECT state, stddev_pop(v) / avg(v) AS load_cv, count(*) FILTER (WHERE rain > 2) AS rainy_days, max(date) AS last FROM d WHERE r <= 7 GROUP BY state)
    SELECT *, CASE WHEN load_cv > 0.08 OR rainy_days >= 3 THEN 3 WHEN month(last) BETWEEN 6 AND 9 OR load_cv > 0.04 THEN 5 ELSE 7 END AS "window" FROM s""")
def _(v):
    return bl.adaptive_window(v.frame)


@query("k13_causal_rotated_baseline", "state rot_date rot_block:i baseline:f", """
    WITH r AS (SELECT state, CAST(CASE WHEN block < 33 THEN date - 1 ELSE date END AS DATE) AS rot_date, ((block - 33 + 96) % 96) + 1 AS rot_block, load FROM v_load),
    d AS (SELECT state, rot_date, avg(load) AS m, row_number() OVER (PARTITION BY state ORDER BY rot_date) AS i FROM r GROUP BY state, rot_date),
    p AS (SELECT t.state, t.rot_date AS target, c.rot_date AS cand, c.m, count(*) OVER w AS n, avg(c.m) OVER w AS mu, stddev_samp(c.m) OVER w AS sd FROM d t JOIN d c ON c.state = t.state AND c.i BETWEEN t.i - 7 AND t.i - 1 WINDOW w AS (PARTITION BY t.state, t.rot_date)),
    k AS (SELECT *, CASE WHEN n >= 3 AND sd > 0 THEN abs(m - mu) <= 1.8::DOUBLE * sd ELSE true END AS clean FROM p), q AS (SELECT *, CASE WHEN count(*) FILTER (WHERE clean) OVER (PARTITION BY state, target) >= 2 THEN clean ELSE true END AS keep FROM k),
    x AS (SELECT *, row_number() OVER (PARTITION BY state, target ORDER BY cand DESC) AS rk FROM q WHERE keep)
    SELECT x.state, target AS rot_date, r.rot_block, avg(r.load) AS baseline FROM x JOIN r ON r.state = x.state AND r.rot_date = x.cand WHERE rk <= 2 GROUP BY x.state, target, r.rot_block""")
def _(v):
    return bl.causal_baseline(v.load)


_POOL = """tg AS (SELECT DATE '2024-01-25' AS d), dy AS (SELECT state, date, avg(load) AS level, avg(temperature) AS t, avg(humidity) AS h, avg(greatest(temperature - 24, 0)) AS cdd, avg(greatest(18 - temperature, 0)) AS hdd, max(CASE WHEN precipitation > 0 THEN 1 ELSE 0 END) AS rain,
      max(wind_speed_10m) AS wind FROM v_frame GROUP BY ALL),
    ta AS (SELECT * FROM dy, tg WHERE date = d), c0 AS (SELECT dy.*, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM dy, tg WHERE date < d AND level > 10), c1 AS (SELECT *, 'recent_7' AS pool FROM c0 WHERE r <= 7),
    dn0 AS (SELECT state, date, dn, avg(load) AS mean FROM v_t GROUP BY ALL), dn1 AS (SELECT *, CASE WHEN count(mean) OVER w >= 2 THEN avg(mean) OVER w END AS tr FROM dn0 WINDOW w AS (PARTITION BY state ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    dn2 AS (SELECT *, coalesce(abs((mean - tr) / tr) > 0.06, false) AS an FROM dn1), dn3 AS (SELECT state, date, an OR coalesce(max(CAST(an AS INTEGER)) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) = 1 AS ex FROM dn2),
    c2 AS (SELECT c1.*, ex, count(*) FILTER (WHERE NOT ex) OVER (PARTITION BY c1.state) AS ok FROM c1 JOIN dn3 USING (state, date)), c3 AS (SELECT c2.*, ta.t AS tt, ta.h AS th, ta.cdd AS tc, ta.hdd AS thd, ta.rain AS train, ta.wind AS twind,
      c2.rain = 0 AND coalesce(c2.wind, 0) <= 30 AS calm FROM c2 JOIN ta USING (state) WHERE ok < 5 OR NOT ex), c4 AS (SELECT *, count(*) FILTER (WHERE calm) OVER (PARTITION BY state) AS nc FROM c3),
    c5 AS (SELECT *, abs(t - tt) AS dt, abs(h - th) AS dh, abs(cdd - tc) + abs(hdd - thd) AS dd FROM c4 WHERE NOT (train = 0 AND coalesce(twind, 0) <= 30) OR nc = 0 OR calm),
    c6 AS (SELECT *, stddev_pop(dt) OVER w AS sdt, stddev_pop(dh) OVER w AS sdh, stddev_pop(dd) OVER w AS sdd FROM c5 WINDOW w AS (PARTITION BY state)),
    c7 AS (SELECT *, 0.55::DOUBLE * 0.7::DOUBLE * coalesce(dt, 0) / CASE WHEN sdt > 1e-9 THEN sdt ELSE 1 END + 0.55::DOUBLE * 0.3::DOUBLE * coalesce(dd, 0) / CASE WHEN sdd > 1e-9 THEN sdd ELSE 1 END + 0.25::DOUBLE * coalesce(dh, 0) / CASE WHEN sdh > 1e-9 THEN sdh ELSE 1 END AS score,
      CASE WHEN isodow(date) = isodow(DATE '2024-01-25') THEN 0 WHEN (isodow(date) >= 6) = (isodow(DATE '2024-01-25') >= 6) THEN 1 ELSE 3 END AS tier FROM c6),
    c8 AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY tier, round(score, 9), date DESC) AS rank FROM c7 WHERE tier < 3),
    r0 AS (SELECT *, avg(level) OVER w AS m, stddev_samp(level) OVER w AS s, count(*) OVER w AS n FROM c0 WHERE r <= 7 WINDOW w AS (PARTITION BY state)), r1 AS (SELECT *, CASE WHEN n >= 3 AND s > 0 THEN abs(level - m) <= 1.8::DOUBLE * s ELSE true END AS cl FROM r0),
    r2 AS (SELECT *, cl OR count(*) FILTER (WHERE cl) OVER (PARTITION BY state) < 2 AS clean FROM r1), lv AS (SELECT state, avg(level) AS lvl FROM r2 WHERE clean GROUP BY state),
    pl AS (SELECT c8.state, c8.date, pool, tier, score, rank, coalesce(least(greatest(lvl / c8.level, 0.7), 1.5), 1) AS scale, CASE tier WHEN 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN pool = 'recent_7' AND coalesce(r2.clean, false) THEN 1.3::DOUBLE ELSE 1 END AS weight
      FROM c8 LEFT JOIN lv USING (state) LEFT JOIN r2 ON r2.state = c8.state AND r2.date = c8.date WHERE rank <= 4)"""
_WEEKEND_POOL = _POOL.replace("2024-01-25", "2024-01-27")


def _pool(v, target="2024-01-25"):
    return sim.similar_day_pool(shared(sim.day_features(v.frame, *sim.degree_bases(target))), target, top=4, min_level=10.0)


@query("k14_similar_day_pool_weekend", "state date pool tier:i score:f rank:i scale:f weight:f", f"WITH {_WEEKEND_POOL} SELECT * FROM pl")
def _(v):
    return _pool(v, "2024-01-27")


@query("k14_last_year_days", "state date load:f", "SELECT state, date, load FROM v_daily WHERE date BETWEEN DATE '1996-06-08' AND DATE '1996-06-22'")
def _(v):
    return sim.last_year_days(v.daily, "1997-06-15")


@query("k14_similar_day_pool", "state date pool tier:i score:f rank:i scale:f weight:f", f"WITH {_POOL} SELECT * FROM pl")
def _(v):
    return _pool(v)


@query("k14_similar_day_baseline", "state block:i baseline:f days:i", f"""
    WITH {_POOL} SELECT l.state, l.block, sum(load * scale * weight) / sum(weight) AS baseline, count(*) AS days FROM v_load l JOIN pl USING (state, date) GROUP BY l.state, l.block""")
def _(v):
    return sim.similar_day_baseline(v.load, _pool(v))


def _pools(dy, level, top):
    """Similar days of every target in SQL: all pairs of days, rules as window conditions per target."""
    w = "PARTITION BY state, target"
    return f"""dy AS ({dy}), an0 AS (SELECT state, date, date - DATE '1970-01-01' AS dn, level AS mean FROM dy), an1 AS (SELECT *, CASE WHEN count(mean) OVER w >= 2 THEN avg(mean) OVER w END AS tr FROM an0 WINDOW w AS (PARTITION BY state ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    an2 AS (SELECT *, coalesce(abs((mean - tr) / nullif(tr, 0)) > 0.06, false) AS an FROM an1), an3 AS (SELECT state, date, an OR coalesce(max(CAST(an AS INTEGER)) OVER (PARTITION BY state ORDER BY dn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) = 1 AS ex FROM an2),
    p0 AS (SELECT c.*, g.date AS target, g.t AS tt, g.h AS th, g.cdd AS tc, g.hdd AS thd, g.rain AS train, g.wind AS twind, g.hol AS thol, isodow(g.date) AS tw, row_number() OVER (PARTITION BY c.state, g.date, isodow(c.date) ORDER BY c.date DESC) AS wr FROM dy g JOIN dy c ON c.state = g.state AND c.date < g.date),
    p1 AS (SELECT *, row_number() OVER ({w} ORDER BY date DESC) AS r FROM p0 WHERE level > {level}),
    p2 AS (SELECT *, CASE WHEN r <= 7 THEN 'recent_7' ELSE 'current_month' END AS pool, isodow(date) = tw AND wr <= 14 AS same FROM p1
      WHERE r <= 7 OR (year(date) < year(target) AND month(date) = month(target) AND abs(date - make_date(year(date), month(target), least(day(target), 28))) <= 21)),
    p3 AS (SELECT *, count(*) FILTER (WHERE same) OVER ({w}) AS nw, count(*) FILTER (WHERE hol = 1) OVER ({w}) AS nh FROM p2), p4 AS (SELECT p3.*, ex, count(*) FILTER (WHERE NOT ex) OVER ({w}) AS ok FROM p3 JOIN an3 USING (state, date) WHERE CASE WHEN thol = 1 THEN nh < 3 OR hol = 1 ELSE tw < 6 OR nw < 4 OR same END),
    p5 AS (SELECT *, rain = 0 AND coalesce(wind, 0) <= 30 AS calm FROM p4 WHERE ok < 5 OR NOT ex), p6 AS (SELECT *, count(*) FILTER (WHERE calm) OVER ({w}) AS nc FROM p5),
    p7 AS (SELECT *, abs(t - tt) AS dt, abs(h - th) AS dh, abs(cdd - tc) + abs(hdd - thd) AS dd FROM p6 WHERE NOT (train = 0 AND coalesce(twind, 0) <= 30) OR nc = 0 OR calm),
    p8 AS (SELECT *, stddev_pop(dt) OVER w AS sdt, stddev_pop(dh) OVER w AS sdh, stddev_pop(dd) OVER w AS sdd FROM p7 WINDOW w AS ({w})),
    p9 AS (SELECT *, 0.55::DOUBLE * 0.7::DOUBLE * coalesce(dt, 0) / CASE WHEN sdt > 1e-9 THEN sdt ELSE 1 END + 0.55::DOUBLE * 0.3::DOUBLE * coalesce(dd, 0) / CASE WHEN sdd > 1e-9 THEN sdd ELSE 1 END + 0.25::DOUBLE * coalesce(dh, 0) / CASE WHEN sdh > 1e-9 THEN sdh ELSE 1 END AS score,
      CASE WHEN isodow(date) = tw THEN 0 WHEN (isodow(date) >= 6) = (tw >= 6) THEN 1 END AS tier FROM p8),
    p10 AS (SELECT *, row_number() OVER ({w} ORDER BY tier, round(score, 9), date DESC) AS rank FROM p9 WHERE tier IS NOT NULL),
    r0 AS (SELECT state, target, date, level, avg(level) OVER w AS m, stddev_samp(level) OVER w AS s, count(*) OVER w AS n FROM p1 WHERE r <= 7 WINDOW w AS ({w})), r1 AS (SELECT *, CASE WHEN n >= 3 AND s > 0 THEN abs(level - m) <= 1.8::DOUBLE * s ELSE true END AS cl FROM r0),
    r2 AS (SELECT *, cl OR count(*) FILTER (WHERE cl) OVER ({w}) < 2 AS clean FROM r1), lv AS (SELECT state, target, avg(level) AS lvl FROM r2 WHERE clean GROUP BY ALL),
    pls AS (SELECT p10.state, p10.target, p10.date, pool, tier, score, rank, coalesce(least(greatest(lvl / p10.level, 0.7), 1.5), 1) AS scale, CASE tier WHEN 0 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN pool = 'recent_7' AND coalesce(r2.clean, false) THEN 1.3::DOUBLE ELSE 1 END AS weight
      FROM p10 LEFT JOIN lv USING (state, target) LEFT JOIN r2 ON r2.state = p10.state AND r2.target = p10.target AND r2.date = p10.date WHERE rank <= {top})"""


_ALL_DAYS = _pools("""SELECT state, date, avg(load) AS level, avg(temperature) AS t, avg(humidity) AS h, avg(greatest(temperature - 24, 0)) AS cdd, avg(greatest(18 - temperature, 0)) AS hdd, max(CASE WHEN precipitation > 0 THEN 1 ELSE 0 END) AS rain, max(wind_speed_10m) AS wind, max(is_holiday) AS hol FROM v_frame GROUP BY ALL""", 10, 4)


def _all_pools(v):
    # January: the degree bases of winter
    return targets.similar_day_pools(targets.day_features(v.frame), top=4, min_level=10.0)


@query("k14_all_targets_pools", "state target date pool tier:i score:f rank:i scale:f weight:f", f"WITH {_ALL_DAYS} SELECT * FROM pls")
def _(v):
    return _all_pools(v)


@query("k14_all_targets", "state target block:i baseline:f days:i", f"""
    WITH {_ALL_DAYS} SELECT l.state, target, l.block, sum(load * scale * weight) / sum(weight) AS baseline, count(*) AS days FROM v_load l JOIN pls USING (state, date) GROUP BY ALL""")
def _(v):
    return targets.similar_day_baselines(v.load, _all_pools(v))


@query("k14_all_targets_of_years", "state target date pool tier:i rank:i scale:f weight:f", f"""
    WITH {_pools("SELECT state, date, load AS level, NULL::DOUBLE AS t, NULL::DOUBLE AS h, NULL::DOUBLE AS cdd, NULL::DOUBLE AS hdd, 0 AS rain, NULL::DOUBLE AS wind, CAST(date IN (SELECT holiday FROM v_hol) AS INTEGER) AS hol FROM v_daily", 0.5, 6)} SELECT * FROM pls""")
def _(v):
    day = holiday_flag(v.daily, v.hol, "is_holiday").select("is_holiday", "state", "date", F.col("load").alias("level"), *[F.lit(None).cast("double").alias(c) for c in ("t", "h", "wind")], *[F.array(*[F.lit(None).cast("double")] * 3).alias(c) for c in ("cdd", "hdd")], F.lit(0).alias("rain"))
    return targets.similar_day_pools(day, top=6, min_level=0.5)


_SD = "SELECT state, date, avg(temperature) AS t, avg(humidity) AS h, max(CASE WHEN precipitation > 0 THEN 1.0::DOUBLE ELSE 0 END) AS r, sum(load) AS l FROM v_frame WHERE date < DATE '2024-01-28'"


@query("k15_similarity_weights", "state days:i w_temp:f w_humidity:f w_rain:f rain_effect:f require_rain_match", f"""
    WITH dy AS ({_SD} GROUP BY ALL), pk AS ({_SD} AND block BETWEEN 33 AND 72 GROUP BY ALL), a AS ({spearman_wide('dy', 'state', {'st': ('t', 'l'), 'sh': ('h', 'l'), 'sr': ('r', 'l')})}),
    b AS ({spearman_wide('pk', 'state', {'pt': ('t', 'l'), 'ph': ('h', 'l'), 'pr': ('r', 'l')})}), pn AS (SELECT state, count(*) AS pn FROM pk GROUP BY state),
    s AS (SELECT state, count(*) AS days, count(*) FILTER (WHERE r > 0.5) AS rainy, coalesce(abs(avg(l) FILTER (WHERE r > 0.5) - avg(l) FILTER (WHERE r <= 0.5)) / avg(l), 0) AS rain_effect FROM dy GROUP BY state),
    j AS (SELECT s.*, CASE WHEN pn >= 10 THEN 0.4::DOUBLE * abs(st) + 0.6::DOUBLE * abs(pt) ELSE abs(st) END AS x, CASE WHEN pn >= 10 THEN 0.4::DOUBLE * abs(sh) + 0.6::DOUBLE * abs(ph) ELSE abs(sh) END AS y,
      CASE WHEN pn >= 10 THEN 0.4::DOUBLE * abs(sr) + 0.6::DOUBLE * abs(pr) ELSE abs(sr) END AS z FROM s JOIN a USING (state) JOIN b USING (state) JOIN pn USING (state))
    SELECT state, days, CASE WHEN days >= 10 AND x + y + z > 1e-9 THEN 0.65::DOUBLE * x / (x + y + z) + 0.35::DOUBLE * 0.55::DOUBLE ELSE 0.55 END AS w_temp, CASE WHEN days >= 10 AND x + y + z > 1e-9 THEN 0.65::DOUBLE * y / (x + y + z) + 0.35::DOUBLE * 0.25::DOUBLE ELSE 0.25 END AS w_humidity,
      CASE WHEN days >= 10 AND x + y + z > 1e-9 THEN 0.65::DOUBLE * z / (x + y + z) + 0.35::DOUBLE * 0.2::DOUBLE ELSE 0.2 END AS w_rain, rain_effect, rainy >= 3 AND days - rainy >= 3 AND rain_effect >= 0.01 AND rainy * 1.0 / days BETWEEN 0.03 AND 0.97 AS require_rain_match FROM j""")
def _(v):
    return sim.similarity_weights(v.frame, "2024-01-28")


@query("k16_persistence_48h", "state date block:i forecast:f upper:f lower:f", """
    WITH l AS (SELECT state, max(date) AS last FROM v_load GROUP BY state), p AS (SELECT state, block, avg(load) AS forecast, stddev_samp(load) AS s, max(last) AS last FROM v_load JOIN l USING (state) WHERE date > last - 7 GROUP BY state, block)
    SELECT state, CAST(last + k AS DATE) AS date, block, forecast, forecast + 1.96::DOUBLE * s AS upper, CASE WHEN s IS NOT NULL THEN greatest(0, forecast - 1.96::DOUBLE * s) END AS lower FROM p CROSS JOIN (VALUES (1), (2)) t(k)""")
def _(v):
    return bl.persistence_48h(v.load)


@query("k17_two_step_t2", "state date block:i t1_date forecast:f anchor:f bridged:f", """
    WITH g AS (SELECT g.state, g.date, g.block, l.load AS f FROM v_grid g LEFT JOIN v_load l ON l.state = g.state AND l.block = g.block AND l.date = g.date - 2),
    t1 AS (SELECT g.state, g.date, g.block, a.load AS f1, b.load AS l7 FROM v_grid g JOIN v_load a ON a.state = g.state AND a.block = g.block AND a.date = g.date - 1 LEFT JOIN v_load b ON b.state = g.state AND b.block = g.block AND b.date = g.date - 7 WHERE g.block > 92),
    an AS (SELECT state, CAST(date + 1 AS DATE) AS date, sum(CASE WHEN l7 IS NOT NULL THEN 0.6::DOUBLE * l7 + 0.4::DOUBLE * f1 ELSE f1 END * exp((block - 93) / 3.0::DOUBLE)) / sum(exp((block - 93) / 3.0::DOUBLE)) AS anchor FROM t1 GROUP BY ALL),
    x AS (SELECT g.*, anchor, max(f) FILTER (WHERE g.block = 1) OVER (PARTITION BY g.state, g.date) AS f1 FROM g LEFT JOIN an USING (state, date))
    SELECT state, date, block, CAST(date - 1 AS DATE) AS t1_date, f AS forecast, anchor, f + coalesce((anchor - f1) * CASE WHEN block <= 8 THEN 0.5::DOUBLE * (1 + cos(pi() * (block - 1) / 7)) ELSE 0 END, 0) AS bridged FROM x""")
def _(v):
    t2 = v.grid.withColumn("forecast", day_lag("load", 2))
    t1 = v.grid.withColumn("forecast", day_lag("load", 1)).where("forecast is not null")
    return fc.two_step(t1, t2, v.load)


@query("k18_synthetic_day", "state date block:i temperature:f synthetic:i", """
    SELECT d.state, DATE '2024-02-01' AS date, b.block, f.temperature, 1 AS synthetic FROM (SELECT DISTINCT state FROM v_frame WHERE date = DATE '2024-01-20') d CROSS JOIN (SELECT CAST(unnest(range(1, 97)) AS INTEGER) AS block) b
    LEFT JOIN v_frame f ON f.state = d.state AND f.block = b.block AND f.date = DATE '2024-01-20' """)
def _(v):
    return bl.synthetic_day(v.frame, "2024-01-20", "2024-02-01")


@query("k19_naive_residual_summary", "state mape_pct:f rmse_mw:f bias_mw:f max_under_forecast_mw:f max_over_forecast_mw:f", """
    SELECT state, avg(abs((actual - forecast) / nullif(actual, 0))) * 100 AS mape_pct, sqrt(avg((actual - forecast) ** 2)) AS rmse_mw, avg(actual - forecast) AS bias_mw, max(actual - forecast) AS max_under_forecast_mw, min(actual - forecast) AS max_over_forecast_mw FROM v_pair GROUP BY state""")
def _(v):
    return bl.residual_summary(bl.naive_residuals(v.load))


@query("k19_block_bias", "state block:i bias:f", "SELECT state, block, avg(actual - forecast) AS bias FROM v_pair GROUP BY state, block")
def _(v):
    return bl.naive_residuals(v.load).groupBy("state", "block").agg(F.avg("residual").alias("bias"))


@query("k20_additive_assembly", "state date block:i corr_level:f forecast:f", """
    WITH d AS (SELECT state, date, avg(load - baseline) FILTER (WHERE block BETWEEN 29 AND 36) AS lc FROM v_base GROUP BY ALL),
    x AS (SELECT b.*, CASE WHEN is_weekend = 1 THEN -5.0::DOUBLE ELSE 0 END AS co, coalesce(lc, 0) * exp(-0.693::DOUBLE * greatest(block - 36, 0) / 24) AS corr_level FROM v_base b JOIN d USING (state, date) WHERE baseline IS NOT NULL)
    SELECT state, date, block, corr_level, CASE WHEN block <= 36 AND load IS NOT NULL THEN load ELSE greatest(baseline + co + corr_level, 0) END AS forecast FROM x""")
def _(v):
    lc = v.base.groupBy("state", "date").agg(F.avg(F.when(F.col("block").between(29, 36), F.col("load") - F.col("baseline"))).alias("level_correction"))
    d = v.base.join(lc, ["state", "date"]).where("baseline is not null").withColumn("calendar_offset", F.when(F.col("is_weekend") == 1, -5.0).otherwise(0.0))
    return bl.assemble(d, half_life=24.0, settled=36)


@query("k21_normal_band", "state date block:i sigma:f p10:f p90:f confidence:f", """
    WITH s AS (SELECT *, stddev_pop(actual - forecast) OVER (PARTITION BY state, block ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 28 PRECEDING AND 1 PRECEDING) AS sigma FROM v_pair),
    b AS (SELECT *, greatest(forecast - 1.2816::DOUBLE * sigma, 0) AS p10, forecast + 1.2816::DOUBLE * sigma AS p90 FROM s WHERE sigma IS NOT NULL)
    SELECT *, greatest(0, least(100, 100 - (p90 - p10) / forecast * 100)) AS confidence FROM b""")
def _(v):
    return bl.normal_band(bl.block_sigma(v.pair).where("sigma is not null"))


@query("k22_two_targets_per_day", "state issued_on horizon:i date block:i forecast:f", """
    SELECT state, issued_on, horizon, CAST(issued_on + horizon AS DATE) AS date, block, forecast FROM (SELECT l.state, CAST(l.date AS DATE) AS issued_on, h.horizon, l.block, l.load AS forecast FROM v_load l CROSS JOIN (VALUES (1), (2)) h(horizon))""")
def _(v):
    return fc.issue(v.load, horizons=(1, 2))


@query("k23_forecast_every_date", "state date block:i load:f forecast:f", f"""
    WITH {_REF}
    SELECT state, date, block, load, point AS forecast FROM rf WHERE date BETWEEN DATE '2024-01-15' AND DATE '2024-01-28' """)
def _(v):
    return fc.range_forecast(v.load, v.hol, "2024-01-15", "2024-01-28")


@query("k24_inverse_rmse_blend", "state date block:i blend:f models:i", """
    WITH p AS (SELECT f.*, l.load FROM v_fcm f LEFT JOIN v_load l USING (state, date, block)), m AS (SELECT state, max(date) AS last FROM p WHERE load IS NOT NULL GROUP BY state),
    w AS (SELECT state, model, sqrt(avg((load - forecast) ** 2)) AS rmse FROM p JOIN m USING (state) WHERE load IS NOT NULL AND date > last - 7 GROUP BY ALL)
    SELECT state, date, block, sum(forecast / rmse) / sum(1 / rmse) AS blend, count(*) AS models FROM p JOIN w USING (state, model) WHERE rmse > 0 GROUP BY ALL""")
def _(v):
    return bl.inverse_rmse_blend(v.fcm.join(v.load, ["state", "date", "block"], "left"))


@query("k25_feature_effects", "feature importance_share:f signed_effect:f")
def _(v):
    return fc.feature_effects(v.frame, v.hol)


@query("k26_chronological_split", "state part days:i rows:i", """
    WITH d AS (SELECT state, date, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r, count(*) AS n FROM v_load GROUP BY state, date)
    SELECT state, CASE WHEN r <= 3 THEN 'test' WHEN r <= 10 THEN 'validation' ELSE 'train' END AS part, count(*) AS days, sum(n) AS rows FROM d GROUP BY ALL""")
def _(v):
    s = chronological_split(v.load, 7, 3)
    return s.groupBy("state", "part").agg(F.count_distinct("date").alias("days"), F.count(F.lit(1)).alias("rows"))
