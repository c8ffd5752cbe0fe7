"""2.L forecast corrections and calibration."""

from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import interp, slope
from quarterhour.operators import corrections as co
from quarterhour.operators.anomaly import outage_days
from quarterhour.operators.calendar import day_type, transition_flags, with_calendar
from quarterhour.operators.features import season4
from quarterhour.operators.grid import day_lag

D = "DATE '2024-01-25'"
DAY = "2024-01-25"
N = 36

_ERR = """er AS (SELECT state, date, block, forecast - actual AS error FROM v_pair),
    rd AS (SELECT state, date, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM er WHERE date < DATE '2024-01-25' GROUP BY state, date)"""
_BLK = "(SELECT CAST(unnest(range(1, 97)) AS INTEGER) AS block)"


def smooth4(src, val):
    """edge-padded window of four: two before, one after"""
    return f"""SELECT a.state, a.block, avg(b.{val}) AS bias FROM {src} a CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS k) o JOIN {src} b ON b.state = a.state AND b.block = least(greatest(a.block + o.k, 1), 96) GROUP BY a.state, a.block"""


_TAB = f"""{_ERR}, ee AS (SELECT er.* FROM er JOIN rd USING (state, date) WHERE r <= 14), md AS (SELECT state, block, median(error) AS raw0 FROM ee GROUP BY state, block),
    gg AS (SELECT s.state, b.block, raw0 FROM (SELECT DISTINCT state FROM er) s CROSS JOIN {_BLK} b LEFT JOIN md USING (state, block)), fl AS (SELECT state, block, coalesce(filled, 0) AS raw FROM ({interp('gg', 'state', 'block', 'raw0')})), bt AS ({smooth4('fl', 'raw')})"""


def errors(v):
    return v.pair.select("state", "date", "block", (F.col("forecast") - F.col("actual")).alias("error"))


def from_day(v):
    """The forecasts that a table made on DAY may be applied to."""
    return v.pair.where(F.col("date") >= F.lit(DAY).cast("date"))


@query("l1_bias_table", "state block:i raw:f bias:f", f"WITH {_TAB} SELECT fl.state, fl.block, raw, bias FROM fl JOIN bt USING (state, block)")
def _(v):
    return co.bias_table(errors(v), DAY, 14)


@query("l1_bias_table_weekend", "state block:i raw:f", f"""
    WITH {_ERR}, k AS (SELECT *, isodow(date) >= 6 AS m, count(*) FILTER (WHERE isodow(date) >= 6) OVER (PARTITION BY state) AS n FROM rd WHERE r <= 14), ee AS (SELECT er.* FROM er JOIN k USING (state, date) WHERE n < 3 OR m),
    md AS (SELECT state, block, median(error) AS raw0 FROM ee GROUP BY state, block), gg AS (SELECT s.state, b.block, raw0 FROM (SELECT DISTINCT state FROM er) s CROSS JOIN {_BLK} b LEFT JOIN md USING (state, block))
    SELECT state, block, coalesce(filled, 0) AS raw FROM ({interp('gg', 'state', 'block', 'raw0')})""")
def _(v):
    return co.bias_table(errors(v), DAY, 14, day_type="weekend")


@query("l1_causal_proxy_errors", "state date block:i error:f", """
    WITH p AS (SELECT *, CASE WHEN count(load) OVER a >= 3 THEN avg(load) OVER a END AS p, CASE WHEN count(load) OVER b >= 2 THEN avg(load) OVER b END AS n FROM v_t
      WINDOW a AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    d AS (SELECT state, date, avg(abs((load - n) / nullif(n, 0))) AS dev FROM p WHERE block <= 32 GROUP BY state, date)
    SELECT p.state, p.date, p.block, p.p - load AS error FROM p LEFT JOIN d USING (state, date) WHERE coalesce(dev, 0) <= 1.1 AND p.p IS NOT NULL""")
def _(v):
    return co.proxy_errors(v.load, window=14, night_limit=1.1)


@query("l2_apply_bias", "state date block:i forecast:f applied:f corrected:f", f"""
    WITH {_TAB} SELECT p.state, p.date, p.block, p.forecast, CASE WHEN p.block > {N} THEN -coalesce(bias, 0) ELSE 0 END AS applied, CASE WHEN p.block > {N} THEN greatest(p.forecast - coalesce(bias, 0), 0) ELSE p.forecast END AS corrected
    FROM v_pair p LEFT JOIN bt USING (state, block) WHERE date >= {D}""")
def _(v):
    return co.apply_bias(from_day(v), co.bias_table(errors(v), DAY, 14), N)


_BT = "CASE WHEN (block - 1) // 4 < 6 THEN 'n' WHEN (block - 1) // 4 < 12 THEN 'm' WHEN (block - 1) // 4 < 18 THEN 'a' ELSE 'e' END || CAST(isodow(date) >= 6 AS VARCHAR)"


@query("l3_block_type_calibration", "state date block:i applied:f calibrated:f", f"""
    WITH {_ERR}, ee AS (SELECT er.state, {_BT} AS t, median(error) AS e FROM er JOIN rd USING (state, date) WHERE r <= 21 GROUP BY ALL), p AS (SELECT *, {_BT} AS t FROM v_pair WHERE date >= {D})
    SELECT p.state, p.date, p.block, CASE WHEN block > {N} THEN -coalesce(e, 0) ELSE 0 END AS applied, CASE WHEN block > {N} THEN greatest(forecast - coalesce(e, 0), 0) ELSE forecast END AS calibrated FROM p LEFT JOIN ee USING (state, t)""")
def _(v):
    return co.block_type_calibration(from_day(v), v.pair, DAY, 21, N)


_T2E = "t2 AS (SELECT a.state, a.date, a.block, a.load AS actual, b.load AS forecast, b.load - a.load AS error FROM v_load a JOIN v_load b ON b.state = a.state AND b.block = a.block AND b.date = a.date - 2)"
_TAPER = "CASE WHEN block <= 32 THEN 1.0::DOUBLE WHEN block <= 48 THEN 1 - 0.7::DOUBLE * (block - 33) / 15 ELSE 0 END"
_NIGHT = f"""{_T2E}, me AS (SELECT state, block, median(error) AS m, count(error) AS samples FROM t2 GROUP BY state, block), nb AS (SELECT s.state, b.block, coalesce(samples, 0) AS samples, CASE WHEN samples >= 20 THEN -m ELSE 0 END AS c FROM (SELECT DISTINCT state FROM t2) s CROSS JOIN {_BLK} b LEFT JOIN me USING (state, block)),
    na AS (SELECT *, max(CASE WHEN block <= 32 AND abs(c) > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY state) AS anyc FROM nb), nt AS (SELECT state, block, samples, CASE WHEN anyc = 0 AND block <= 32 THEN CASE WHEN block <= 16 THEN 35 * 1.15::DOUBLE ELSE 35 END ELSE c END * {_TAPER} AS correction FROM na)"""


def t2_pairs(v):
    return v.load.select("state", "date", "block", F.col("load").alias("actual"), day_lag("load", 2).alias("forecast")).where("forecast is not null")


def night(v):
    e = t2_pairs(v).select("state", "date", "block", (F.col("forecast") - F.col("actual")).alias("error"))
    return co.t2_night_table(e, min_samples=20, fallback=35.0)


@query("l4_t2_night_table", "state block:i correction:f samples:i", f"WITH {_NIGHT} SELECT * FROM nt")
def _(v):
    return night(v)


@query("l4_t2_night_applied", "state date block:i corrected:f", f"WITH {_NIGHT} SELECT t2.state, t2.date, t2.block, greatest(forecast + coalesce(correction, 0), 0) AS corrected FROM t2 LEFT JOIN nt USING (state, block)")
def _(v):
    return co.add_table(t2_pairs(v), night(v))


@query("l4_t2_segment_table", "state block:i correction:f", f"""
    WITH r AS (SELECT s.state, b.block, (MAP {{ {', '.join(f'{k}: {x}::DOUBLE' for k, x in co.T2_SEGMENT_MW.items())} }})[(b.block - 1) // 8 * 8 + 1] AS raw FROM (SELECT DISTINCT state FROM v_load) s CROSS JOIN {_BLK} b)
    SELECT a.state, a.block, avg(b.raw) AS correction FROM r a CROSS JOIN (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS k) o JOIN r b ON b.state = a.state AND b.block = ((a.block + o.k - 1 + 96) % 96) + 1 GROUP BY a.state, a.block""")
def _(v):
    return co.t2_segment_table(v.load)


@query("l5_afternoon_ramp", "state date block:i multiplier:f adjust_pct:f adjust_mw:f", """
    WITH rg AS (SELECT state, date, CASE WHEN p > 1 OR px > 5 THEN 'RAINY' WHEN tx > 42 AND h < 35 AND w > 25 THEN 'DUSTY' WHEN tx > 42 OR (tx > 40 AND h < 45) THEN 'HOT' WHEN c > 75 AND w > 25 THEN 'DUSTY' ELSE 'NORMAL' END AS regime
      FROM (SELECT state, date, avg(precipitation) AS p, max(precipitation) AS px, max(temperature) AS tx, avg(humidity) AS h, max(wind_speed_10m) AS w, avg(cloud_cover) AS c FROM v_base GROUP BY ALL)),
    x AS (SELECT b.*, regime, coalesce(temperature, 25) AS tq, coalesce(humidity, 50) AS hh FROM v_base b JOIN rg USING (state, date)),
    y AS (SELECT *, CASE WHEN hour BETWEEN 13 AND 17 THEN least(1.6, 1 + 0.04::DOUBLE * greatest(0, tq - 38)) * (1 + 0.3::DOUBLE * sin(pi() * least(greatest((hour - 13) / 4.0::DOUBLE, 0), 1))) WHEN hour BETWEEN 10 AND 12 THEN 1.15::DOUBLE ELSE 1 END AS multiplier,
      least(greatest(pow(greatest(0, tq - 24), 1.5::DOUBLE) / 120 + (tq * (1 + hh / 100) - 36) / 1200, 0), 0.035::DOUBLE) AS heat FROM x),
    z AS (SELECT *, CASE WHEN hour BETWEEN 13 AND 17 THEN least(greatest(CASE WHEN regime = 'HOT' THEN least(greatest((multiplier - 1) * 0.055::DOUBLE, 0), 0.08::DOUBLE) WHEN regime = 'DUSTY' THEN -0.04::DOUBLE WHEN regime = 'RAINY' THEN -0.025::DOUBLE
      ELSE least(greatest((multiplier - 1) * 0.025::DOUBLE, 0), 0.035::DOUBLE) END + heat, -0.05::DOUBLE), 0.1::DOUBLE) ELSE 0 END AS p0 FROM y),
    q AS (SELECT *, CASE WHEN tq <= 18 THEN least(greatest(p0 + pow(greatest(0, 18 - tq), 1.3::DOUBLE) / 180, -0.05::DOUBLE), 0.06::DOUBLE) ELSE p0 END AS adjust_pct FROM z)
    SELECT state, date, block, multiplier, adjust_pct, baseline * adjust_pct AS adjust_mw FROM q""")
def _(v):
    return co.afternoon_ramp(v.base, "baseline", F.lit(True))


@query("l6_residual_bias", "state block:i fast:f slow:f bias:f", f"""
    WITH r AS (SELECT *, load - avg(load) OVER (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS resid FROM v_t WHERE date < {D}),
    o AS (SELECT state, date FROM (SELECT *, max(load) OVER (PARTITION BY state, date ORDER BY block RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS l FROM v_frame) GROUP BY state, date HAVING coalesce(bool_or(l > 300 AND (load - l) / l < -0.95), false) OR coalesce(bool_or(wind_speed_10m >= 100), false)),
    k AS (SELECT r.* FROM r WHERE resid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.state = r.state AND o.date = r.date)), dd AS (SELECT state, date, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS rk FROM k GROUP BY state, date),
    x AS (SELECT k.*, rk FROM k JOIN dd USING (state, date) WHERE rk <= 60), m AS (SELECT state, median(resid) AS m FROM x GROUP BY state), a AS (SELECT x.state, median(abs(resid - m)) AS mad FROM x JOIN m USING (state) GROUP BY x.state),
    b AS (SELECT state, block, coalesce(avg(resid) FILTER (WHERE rk <= 5), 0) AS f, avg(resid) AS slow FROM x GROUP BY state, block), c AS (SELECT b.*, CASE WHEN mad > 0 THEN least(greatest(f, -3 * mad), 3 * mad) ELSE f END AS fast FROM b JOIN a USING (state))
    SELECT state, block, fast, slow, 0.4::DOUBLE * fast + 0.1::DOUBLE * slow AS bias FROM c""")
def _(v):
    return co.residual_bias(v.load, DAY, outage_days(v.frame, drop=0.95, wind_limit=100.0, floor=300.0))


@query("l7_partial_day_correction", "state date block:i corr_pct:f corrected:f fit_points:i", f"""
    WITH e AS (SELECT state, date, CAST(block AS DOUBLE) AS block, least(greatest((actual - forecast) / abs(forecast), -0.2), 0.2) AS err FROM v_pair WHERE block <= {N} AND actual IS NOT NULL AND abs(forecast) > 1e-6),
    m AS (SELECT state, date, median(err) AS m, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT e.*, m, n FROM e JOIN m USING (state, date)), md AS (SELECT state, date, median(abs(err - m)) AS mad FROM a GROUP BY ALL),
    k AS (SELECT a.*, abs(err - m) <= greatest(0.02, 3 * mad) AS keep FROM a JOIN md USING (state, date)), q AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY state, date) AS kk FROM k),
    f AS (SELECT state, date, {slope('err', 'block')} AS s, avg(err) - {slope('err', 'block')} * avg(block) AS i, avg(err) AS av, count(*) AS fit_points, max(n) AS n FROM q WHERE kk < 4 OR keep GROUP BY ALL),
    g AS (SELECT state, date, fit_points, n, CASE WHEN fit_points >= 6 THEN coalesce(s, 0) ELSE 0 END AS s, CASE WHEN fit_points >= 6 THEN coalesce(i, av) ELSE av END AS i FROM f),
    x AS (SELECT p.*, fit_points, n, least(greatest((i + s * p.block) * least(greatest(fit_points / 48.0::DOUBLE, 0.25), 1), -0.08), 0.08) * CASE WHEN p.block - {N} <= 4 THEN 0.25::DOUBLE + 0.25::DOUBLE * (p.block - {N} - 1) ELSE 1 END AS c FROM v_pair p LEFT JOIN g USING (state, date))
    SELECT state, date, block, fit_points, CASE WHEN block > {N} AND n >= 6 THEN c ELSE 0 END AS corr_pct, CASE WHEN block > {N} AND n >= 6 THEN greatest(0, forecast * (1 + c)) ELSE forecast END AS corrected FROM x""")
def _(v):
    return co.partial_day(v.pair, N)


@query("l8_intraday_recalibration", "state date block:i bias:f mape:f recalibrated:f", f"""
    WITH e AS (SELECT state, date, avg(actual - forecast) FILTER (WHERE ok) AS bias, count(*) FILTER (WHERE ok) AS n, avg(abs(actual - forecast) / greatest(actual, 1)) FILTER (WHERE ok) * 100 AS mape FROM (SELECT *, block <= {N} AND actual > 10 AND forecast > 10 AS ok FROM v_pair) GROUP BY ALL)
    SELECT p.state, p.date, p.block, bias, mape, CASE WHEN n >= 4 AND mape >= 2 THEN greatest(forecast + CASE WHEN block > {N} THEN bias * (1 - (block - {N} - 1) / {96 - N - 1}.0::DOUBLE) ELSE 0 END, 0) ELSE forecast END AS recalibrated FROM v_pair p JOIN e USING (state, date)""")
def _(v):
    return co.intraday_recalibrate(v.pair, N)


@query("l9_t2_night_anchor", "state date block:i carried:f anchored:f", f"""
    WITH {_T2E}, e AS (SELECT state, CAST(date + 1 AS DATE) AS date, avg(actual - forecast) FILTER (WHERE ok) AS b, count(*) FILTER (WHERE ok) AS n FROM (SELECT *, block > 92 AND actual > 10 AND forecast > 10 AS ok FROM v_pair) GROUP BY ALL),
    x AS (SELECT t2.*, coalesce(n >= 2 AND abs(b) >= 5, false) AS u, b * exp(-(t2.block - 1) / 16.0::DOUBLE) AS ad FROM t2 LEFT JOIN e USING (state, date))
    SELECT state, date, block, CASE WHEN u THEN ad ELSE 0 END AS carried, CASE WHEN u THEN greatest(forecast + ad, 0) ELSE forecast END AS anchored FROM x""")
def _(v):
    return co.t2_night_anchor(t2_pairs(v), v.pair)


@query("l10_seam_continuity", "state date block:i gap_before:f bridged:f", """
    WITH a AS (SELECT state, CAST(date + 1 AS DATE) AS date, max(actual) FILTER (WHERE block = 96) AS anchor FROM v_pair GROUP BY ALL),
    x AS (SELECT p.*, anchor, max(CASE WHEN block = 1 THEN forecast END) OVER (PARTITION BY p.state, p.date) AS f1 FROM v_pair p LEFT JOIN a USING (state, date))
    SELECT state, date, block, f1 - anchor AS gap_before, forecast + coalesce((anchor - f1) * CASE WHEN block <= 8 THEN 0.5::DOUBLE * (1 + cos(pi() * (block - 1) / 7)) ELSE 0 END, 0) AS bridged FROM x""")
def _(v):
    anchors = v.pair.groupBy("state", "date").agg(F.max(F.when(F.col("block") == 96, F.col("actual"))).alias("anchor"))
    return co.seam(v.pair, anchors, 8)


@query("l10_base_day_seam", "state date block:i bridged:f", """
    WITH l AS (SELECT state, CAST(date + 1 AS DATE) AS date, load AS p FROM v_load WHERE block = 96), x AS (SELECT v.*, p, max(CASE WHEN block = 1 THEN forecast END) OVER (PARTITION BY v.state, v.date) AS f1 FROM v_pair v LEFT JOIN l USING (state, date)),
    t AS (SELECT *, CASE WHEN p IS NOT NULL AND f1 IS NOT NULL THEN p + least(greatest(f1 - p, -greatest(0.05::DOUBLE * greatest(p, f1, 1), 25)), greatest(0.05::DOUBLE * greatest(p, f1, 1), 25)) END AS tg FROM x)
    SELECT state, date, block, CASE WHEN block <= 6 AND tg IS NOT NULL THEN (1 - block / 7.0::DOUBLE) * tg + block / 7.0::DOUBLE * forecast ELSE forecast END AS bridged FROM t""")
def _(v):
    return co.base_seam(v.pair, v.load)


@query("l11_cosine_stitch", "state date block:i stitched:f", f"""
    WITH a AS (SELECT state, date, arg_max(actual, block) FILTER (WHERE block <= {N}) AS a FROM v_pair GROUP BY ALL), x AS (SELECT p.*, a, 0.5::DOUBLE * (1 - cos(pi() * (block - {N}) / 9)) AS w FROM v_pair p JOIN a USING (state, date))
    SELECT state, date, block, CASE WHEN block <= {N} THEN actual WHEN a IS NOT NULL AND block - {N} BETWEEN 1 AND 8 THEN a * (1 - w) + forecast * w ELSE forecast END AS stitched FROM x""")
def _(v):
    return co.stitch(v.pair, N)


@query("l12_live_ratio", "state date block:i live_ratio:f calibrated:f", f"""
    WITH r AS (SELECT state, date, list(actual / forecast ORDER BY block) AS l FROM v_pair WHERE block BETWEEN {N - 23} AND {N} AND forecast > 20 AND actual > 20 GROUP BY ALL),
    e AS (SELECT state, date, CASE WHEN len(l) >= 3 THEN least(greatest(list_reduce(l, lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a), 0.95), 1.05) ELSE 1 END AS lr FROM r)
    SELECT p.state, p.date, p.block, coalesce(lr, 1) AS live_ratio, CASE WHEN block > {N} THEN greatest(forecast * coalesce(lr, 1), 0) ELSE forecast END AS calibrated FROM v_pair p LEFT JOIN e USING (state, date)""")
def _(v):
    return co.live_ratio(v.pair, N, fc_floor=20.0, act_floor=20.0)


@query("l12_anchor_mix", "state block:i anchor:f", f"""
    WITH d AS (SELECT state, date, count(load) AS n FROM v_load WHERE date < {D} GROUP BY ALL HAVING count(load) >= 60), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM d), q AS (SELECT *, isodow(date) = isodow({D}) AS same FROM r WHERE r <= 45),
    s AS (SELECT *, CASE WHEN same THEN row_number() OVER (PARTITION BY state, same ORDER BY date DESC) END AS s FROM q),
    b AS (SELECT l.state, l.block, avg(load) FILTER (WHERE r = 1) AS x1, avg(load) FILTER (WHERE r <= 3) AS x3, avg(load) FILTER (WHERE r <= 7) AS x7, avg(load) FILTER (WHERE s <= 4) AS xs FROM v_load l JOIN s USING (state, date) GROUP BY l.state, l.block)
    SELECT state, block, 0.4::DOUBLE * x1 + 0.3::DOUBLE * x3 + 0.3::DOUBLE * coalesce(xs, x7) AS anchor FROM b""")
def _(v):
    return co.anchor_mix(v.load, DAY, 1, min_blocks=60)


@query("l13_dynamic_shrinkage", "state date block:i weight:f shrunk:f", f"""
    WITH h AS (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) AS dn FROM v_pair), v AS (SELECT *, stddev_samp(actual) OVER w / greatest(avg(actual) OVER w, 1) AS v, avg(actual) OVER (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline FROM h
      WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, least(greatest(0.98::DOUBLE - coalesce(v, 0) * 3, 0.8), 0.98) AS d0, CASE WHEN block BETWEEN 48 AND 72 THEN 0.25::DOUBLE ELSE 0.5 END + 0.2::DOUBLE * {N} / 96 AS w0 FROM v),
    k AS (SELECT *, CASE WHEN block <= {N} THEN 1 ELSE least(w0, CASE WHEN block BETWEEN 48 AND 72 THEN least(greatest(d0 + 0.05::DOUBLE, 0.8), 0.98) ELSE d0 END) END AS weight FROM d)
    SELECT state, date, block, weight, weight * forecast + (1 - weight) * coalesce(baseline, forecast) AS shrunk FROM k""")
def _(v):
    from quarterhour.operators.grid import days_ago
    d = v.pair.withColumn("baseline", F.avg("actual").over(days_ago(("state", "block"), 7, 1)))
    return co.shrink_to_baseline(d, "baseline", v.pair, settled=N)


@query("l14_momentum_carry", "state date block:i carry:f carried:f", f"""
    WITH m AS (SELECT state, date, max(actual) FILTER (WHERE block = {N}) - max(actual) FILTER (WHERE block = {N - 4}) AS m FROM v_pair GROUP BY ALL),
    x AS (SELECT p.*, CASE WHEN block > {N} THEN least(greatest(coalesce(m, 0) * exp(-(block - {N}) / 8.0::DOUBLE), -greatest(0.03::DOUBLE * greatest(forecast, 1), 75)), greatest(0.03::DOUBLE * greatest(forecast, 1), 75)) ELSE 0 END AS carry FROM v_pair p JOIN m USING (state, date))
    SELECT state, date, block, carry, greatest(forecast + carry, 0) AS carried FROM x""")
def _(v):
    return co.momentum_carry(v.pair, N)


@query("l15_diurnal_shape", "state date block:i multiplier:f shaped:f", f"""
    WITH d AS (SELECT state, date, isodow(date) >= 6 AS we, avg(load) FILTER (WHERE block <= {N}) AS mm FROM v_load GROUP BY ALL HAVING avg(load) FILTER (WHERE block <= {N}) > 0),
    t AS (SELECT DISTINCT state, date FROM v_pair), p AS (SELECT t.state, t.date, d.date AS hd, mm, row_number() OVER (PARTITION BY t.state, t.date ORDER BY d.date DESC) AS r, count(*) OVER (PARTITION BY t.state, t.date) AS n FROM t JOIN d ON d.state = t.state AND d.date < t.date AND d.we = (isodow(t.date) >= 6)),
    h AS (SELECT p.state, p.date, l.block, avg(load / mm) AS hs FROM p JOIN v_load l ON l.state = p.state AND l.date = p.hd WHERE r <= 8 AND n >= 3 GROUP BY ALL), f AS (SELECT state, date, avg(forecast) FILTER (WHERE block <= {N}) AS fm FROM v_pair GROUP BY ALL),
    x AS (SELECT v.*, coalesce(CASE WHEN forecast > 0 AND hs IS NOT NULL AND v.block > {N} THEN least(greatest(hs / (forecast / fm), 0.8), 1.2) ELSE 1 END, 1) AS multiplier FROM v_pair v LEFT JOIN h USING (state, date, block) JOIN f USING (state, date))
    SELECT state, date, block, multiplier, forecast * multiplier AS shaped FROM x""")
def _(v):
    return co.diurnal_shape(v.pair, v.load, N)


_FLAGS = """dt AS (SELECT DISTINCT date FROM v_load), fx AS (SELECT date, isodow(date) - 1 AS dow, date IN (SELECT holiday FROM v_hol) AS h, CAST(date + 1 AS DATE) IN (SELECT holiday FROM v_hol) AS n, CAST(date - 1 AS DATE) IN (SELECT holiday FROM v_hol) AS p FROM dt),
    fg AS (SELECT fx.*, days_to_holiday AS dth, days_since_holiday AS dsh FROM fx JOIN v_hd USING (date))"""


@query("l17_calendar_factor", "state date block:i factor:f transition:f", f"""
    WITH {_FLAGS}, dl AS (SELECT state, date, sum(load) AS total FROM v_load GROUP BY ALL), r AS (SELECT state, avg(total) FILTER (WHERE isodow(date) >= 6) / avg(total) FILTER (WHERE isodow(date) < 6) AS w FROM dl GROUP BY state),
    x AS (SELECT g.state, g.date, g.block, fg.* EXCLUDE (date), w, least(w, 0.92) AS hr FROM v_grid g JOIN fg USING (date) JOIN r USING (state))
    SELECT state, date, block, CASE WHEN h THEN hr * CASE WHEN dow = 4 AND block BETWEEN 69 AND 88 THEN 0.95::DOUBLE ELSE 1 END WHEN NOT h AND dow < 5 AND (n OR p) THEN 0.5::DOUBLE * hr + 0.5::DOUBLE WHEN dow >= 5 AND (n OR p) THEN w * 0.97::DOUBLE
      WHEN dth = 1 THEN CASE WHEN block BETWEEN 73 AND 96 THEN 0.97 ELSE 1 END WHEN dsh = 1 THEN CASE WHEN block BETWEEN 21 AND 44 THEN 0.96::DOUBLE + 0.04::DOUBLE * (block - 21) / 23 ELSE 1 END ELSE 1 END AS factor,
      CASE WHEN h AND dow = 0 AND block BETWEEN 21 AND 40 THEN hr + (1 - hr) * (block - 21) / 19 ELSE 1 END AS transition FROM x""")
def _(v):
    flags = transition_flags(v.load.select("date").distinct(), v.hol)
    daily = v.load.groupBy("state", "date").agg(F.sum("load").alias("total"))
    return co.calendar_factor(v.grid.join(flags, "date"), daily)


@query("l18_behaviour_adjustment", "state date block:i adjustment:f", f"""
    WITH p AS (SELECT * FROM (VALUES {co.BEHAVIOUR_ROWS}) t(region, season, day_type, label, b_start, b_end, mw)),
    g AS (SELECT region, season, day_type, block, b_start, b_end, mw, abs(block - (b_start + b_end) / 2.0::DOUBLE) AS gap, greatest((b_end - b_start) / 2.0::DOUBLE / 2.5::DOUBLE, 2) AS sg FROM p CROSS JOIN {_BLK} b),
    a AS (SELECT region, season, day_type, block, sum(mw * exp(-0.5::DOUBLE * pow(least(gap, 96 - gap) / sg, 2))) AS raw FROM g GROUP BY ALL),
    s AS (SELECT a.region, a.season, a.day_type, a.block, avg(b.raw) AS adjustment FROM a CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS k) o JOIN a b ON b.region = a.region AND b.season = a.season AND b.day_type = a.day_type AND b.block = ((a.block + o.k - 1 + 96) % 96) + 1 GROUP BY ALL),
    x AS (SELECT state, date, block, CASE WHEN state = 'R2' THEN 'south' ELSE 'north' END AS region, CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) IN (3,4,5) THEN 'spring' WHEN month(date) IN (6,7,8) THEN 'summer' ELSE 'fall' END AS season,
      CASE WHEN date IN (SELECT holiday FROM v_hol) THEN 'Holiday' WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS broad FROM v_load)
    SELECT x.state, x.date, x.block, coalesce(o.adjustment, f.adjustment, 0) AS adjustment FROM x LEFT JOIN s o ON o.region = x.region AND o.season = x.season AND o.day_type = x.day_type AND o.block = x.block
    LEFT JOIN s f ON f.region = x.region AND f.season = x.season AND f.day_type = x.broad AND f.block = x.block""")
def _(v):
    prof = co.behaviour_adjustment(dims.values_frame(v.spark, "region, season, day_type, label, b_start, b_end, mw", co.BEHAVIOUR_ROWS))
    region = F.when(F.col("state") == "R2", "south").otherwise("north")  # the second has no profiles
    d = with_calendar(v.load, v.hol).withColumn("season", F.lower(season4(F.col("month")))).withColumn("region", region)
    d = d.withColumn("day_type", F.when(F.col("is_holiday") == 1, "Holiday").when(F.col("dow") >= 5, "Weekend").otherwise("Weekday"))
    return co.with_behaviour(d, prof)


def typed(v):
    flags = transition_flags(v.load.select("date").distinct(), v.hol)
    days = flags.select("date", day_type(flags).alias("day_type"))
    return v.load.join(days, "date").withColumn("season", season4(F.month("date")))


@query("l19_behaviour_profile", "state season day_type block:i profile:f n:i", f"""
    WITH {_FLAGS}, ty AS (SELECT date, CASE WHEN h THEN CASE WHEN dow = 4 THEN 'Holiday-Fri' WHEN dow = 0 THEN 'Holiday-Mon' WHEN dow BETWEEN 1 AND 3 THEN 'Holiday-MidWeek' ELSE 'Holiday' END WHEN dow < 5 AND (n OR p) THEN 'BridgeDay'
      WHEN dow >= 5 AND (n OR p) THEN 'LongWeekend' WHEN dow >= 5 THEN 'Weekend' WHEN dow = 4 THEN 'Friday' WHEN dow = 0 THEN 'Monday' ELSE 'Weekday' END AS day_type FROM fg),
    r AS (SELECT *, CASE WHEN count(load) OVER w >= 3 THEN load - avg(load) OVER w END AS resid FROM v_t WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    x AS (SELECT r.*, max(date) OVER (PARTITION BY state) AS last FROM r WHERE resid IS NOT NULL)
    SELECT state, 'Winter' AS season, day_type, block, sum(resid * exp(-0.693::DOUBLE * (last - x.date) / 21)) / sum(exp(-0.693::DOUBLE * (last - x.date) / 21)) AS profile, count(resid) AS n FROM x JOIN ty USING (date) GROUP BY ALL""")
def _(v):
    return co.behaviour_residuals(typed(v))


@query("l19_behaviour_fourier", "state season day_type block:i curve:f profile:f adjustment:f")
def _(v):
    t = typed(v)
    peaks = v.load.groupBy("state").agg(F.percentile("load", F.lit(0.95)).alias("p95"))
    return co.blended_behaviour(co.behaviour_residuals(t), co.behaviour_fourier(t), peaks)


@query("l20_wind_shedding", "state date block:i hub_wind:f shed_mw:f after_shedding:f", """
    WITH d AS (SELECT state, date, max(wind_speed_10m) * 1.4::DOUBLE AS hub_wind FROM v_base GROUP BY ALL), c AS (SELECT *, coalesce(CASE WHEN hub_wind >= 65 THEN least(30 * ln(1 + (hub_wind - 65) / 10) * 10, 600) ELSE 0 END, 0) AS shed_mw FROM d)
    SELECT b.state, b.date, b.block, hub_wind, shed_mw, greatest(baseline - shed_mw, 0) AS after_shedding FROM v_base b JOIN c USING (state, date) WHERE baseline IS NOT NULL""")
def _(v):
    return co.wind_shedding(v.base.where("baseline is not null"), "baseline")


@query("l21_t2_level_normalisation", "state date block:i level_ratio:f normalised:f", f"""
    WITH {_T2E}, b AS (SELECT state, date, avg(forecast) FILTER (WHERE block <= 24 AND forecast > 0) AS bn, avg(forecast) FILTER (WHERE block BETWEEN 41 AND 48 AND forecast > 0) AS bm FROM t2 GROUP BY ALL),
    a AS (SELECT state, CAST(date + 1 AS DATE) AS date, avg(forecast) FILTER (WHERE block <= 24 AND forecast > 0) AS an, avg(forecast) FILTER (WHERE block BETWEEN 41 AND 48 AND forecast > 0) AS am FROM v_pair GROUP BY ALL),
    r AS (SELECT b.state, b.date, CASE WHEN an > 20 AND bn > 20 AND CASE WHEN am > 50 AND bm > 50 THEN 0.7::DOUBLE * an / bn + 0.3::DOUBLE * am / bm ELSE an / bn END > 1
      THEN least(CASE WHEN am > 50 AND bm > 50 THEN 0.7::DOUBLE * an / bn + 0.3::DOUBLE * am / bm ELSE an / bn END, 1.05) ELSE 1 END AS lr FROM b LEFT JOIN a USING (state, date))
    SELECT t2.state, t2.date, t2.block, lr AS level_ratio, 0.7::DOUBLE * forecast + 0.3::DOUBLE * forecast * lr AS normalised FROM t2 JOIN r USING (state, date)""")
def _(v):
    return co.t2_level(v.pair, t2_pairs(v), night_floor=20.0, mid_floor=50.0)


_SEED = f"""s AS (SELECT state, date, sum((actual - forecast) * pow(0.997::DOUBLE, {N} - block)) / sum(pow(0.997::DOUBLE, {N} - block)) AS seed FROM v_pair WHERE block BETWEEN {N - 27} AND {N} GROUP BY ALL)"""


@query("l22_seed_error", "state date block:i seed:f carried_error:f corrected:f", f"""
    WITH {_SEED} SELECT p.state, p.date, p.block, seed, CASE WHEN block > {N} THEN coalesce(seed, 0) * pow(0.997::DOUBLE, block - {N}) ELSE 0 END AS carried_error,
      CASE WHEN block <= {N} THEN actual ELSE forecast + coalesce(seed, 0) * pow(0.997::DOUBLE, block - {N}) END AS corrected FROM v_pair p LEFT JOIN s USING (state, date)""")
def _(v):
    return co.seed_error(v.pair, N)


@query("l22_seed_into_t2", "state date block:i corrected:f", f"""
    WITH {_SEED}, {_T2E}, e AS (SELECT p.state, CAST(p.date + 1 AS DATE) AS date, coalesce(seed, 0) * pow(0.997::DOUBLE, 96 - {N}) AS en FROM v_pair p LEFT JOIN s USING (state, date) WHERE p.block = 96)
    SELECT t2.state, t2.date, t2.block, CASE WHEN abs(en) > 1 THEN greatest(forecast + en * pow(0.997::DOUBLE, t2.block), 0) ELSE forecast END AS corrected FROM t2 LEFT JOIN e USING (state, date)""")
def _(v):
    return co.seed_into_t2(t2_pairs(v), v.pair, N)


@query("l23_seam_anchor", "state date anchor:f", """
    WITH j AS (SELECT p.*, l.load AS l7 FROM v_pair p LEFT JOIN v_load l ON l.state = p.state AND l.block = p.block AND l.date = p.date - 7 WHERE p.block > 92)
    SELECT state, date, sum(CASE WHEN l7 IS NOT NULL THEN 0.6::DOUBLE * l7 + 0.4::DOUBLE * forecast ELSE forecast END * exp((block - 93) / 3.0::DOUBLE)) / sum(exp((block - 93) / 3.0::DOUBLE)) AS anchor FROM j GROUP BY ALL""")
def _(v):
    return co.seam_anchor(v.pair, v.load)
