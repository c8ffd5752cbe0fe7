"""2.M accuracy, backtests and monitoring."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.d_days import inw, part
from quarterhour.catalog.j_weather import _CTX, _fac
from quarterhour.catalog.k_forecasts import _BAND
from quarterhour.catalog.sqlparts import _det
from quarterhour.operators import accuracy as ac
from quarterhour.operators import weather as wx
from quarterhour.operators.baselines import relative_band
from quarterhour.operators.day_stats import DELTA_WINDOWS
from quarterhour.operators.grid import day_lag
from quarterhour.plans import backtest as bt
from quarterhour.plans import forecast as fc
from quarterhour.plans import refit

_MET = "n:i wape:f accuracy_wape:f mae:f rmse:f bias_mw:f peak_wape:f p90_abs_error:f p95_abs_error:f daily_peak_error:f"


def met(src, keys):
    """Aggregate metrics in SQL."""
    k = ", ".join(keys)
    dk = ", ".join(dict.fromkeys([*keys, "state", "date"]))
    return f"""SELECT a.*, pe AS daily_peak_error FROM (SELECT {k}, count(*) AS n, sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100 AS wape, 100 - sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100 AS accuracy_wape,
        avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) ** 2)) AS rmse, avg(forecast - actual) AS bias_mw,
        sum(abs(actual - forecast)) FILTER (WHERE block BETWEEN 69 AND 92) / nullif(sum(abs(actual)) FILTER (WHERE block BETWEEN 69 AND 92), 0) * 100 AS peak_wape,
        quantile_cont(abs(forecast - actual), 0.9) AS p90_abs_error, quantile_cont(abs(forecast - actual), 0.95) AS p95_abs_error FROM {src} WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY {k}) a
      JOIN (SELECT {k}, avg(pe) AS pe FROM (SELECT {dk}, abs(max(forecast) - max(actual)) AS pe FROM {src} WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY {dk}) GROUP BY {k}) b USING ({k})"""


@query("m1_metrics", "state " + _MET, met("v_pair", ["state"]))
def _(v):
    return ac.metrics(v.pair)


def banded(v):
    b = relative_band(fc.reference(v.grid, v.hol, 1), "point", min_rows=500)
    return b.select("state", "date", "block", F.col("load").alias("actual"), F.col("p50").alias("forecast"), "p10", "p90")


@query("m2_pinball_and_coverage", "state pinball_loss:f coverage_pct:f", f"""
    WITH {_BAND}, k AS (SELECT * FROM bnd WHERE load IS NOT NULL AND p50 IS NOT NULL)
    SELECT state, avg((greatest(0.1::DOUBLE * (load - p10), -0.9::DOUBLE * (load - p10)) + greatest(0.5::DOUBLE * (load - p50), -0.5::DOUBLE * (load - p50)) + greatest(0.9::DOUBLE * (load - p90), -0.1::DOUBLE * (load - p90))) / 3) AS pinball_loss,
      avg(CASE WHEN load >= p10 AND load <= p90 THEN 100.0::DOUBLE ELSE 0 END) AS coverage_pct FROM k GROUP BY state""")
def _(v):
    return ac.metrics(banded(v))


@query("m3_daily_metrics", "state date wape:f mae:f peak_error_mw:f", """
    SELECT state, date, sum(abs(actual - forecast)) / nullif(sum(abs(actual)), 0) * 100 AS wape, avg(abs(actual - forecast)) AS mae, abs(max(forecast) - max(actual)) AS peak_error_mw FROM v_pair GROUP BY state, date""")
def _(v):
    return ac.daily_metrics(v.pair)


@query("m4_kpi_summary", "state date mape:f rmse:f bias:f peak_accuracy:f daily_energy_error:f peak_load:f daily_energy:f within_2pct:f within_5pct:f over_10pct:f reserve_margin:f confidence:f peak_status", """
    WITH r AS (SELECT *, abs(actual - forecast) / greatest(actual, 1e-6) AS r FROM v_pair),
    d AS (SELECT state, date, avg(r) * 100 AS mape, sqrt(avg((actual - forecast) ** 2)) AS rmse, avg(forecast - actual) AS bias, abs(max(actual) - max(forecast)) / max(actual) * 100 AS peak_accuracy, abs(sum(actual) - sum(forecast)) / sum(actual) * 100 AS daily_energy_error,
      max(forecast) AS peak_load, sum(forecast) AS daily_energy, avg(CASE WHEN r <= 0.02 THEN 100.0::DOUBLE ELSE 0 END) AS within_2pct, avg(CASE WHEN r <= 0.05 THEN 100.0::DOUBLE ELSE 0 END) AS within_5pct, avg(CASE WHEN r > 0.1 THEN 100.0::DOUBLE ELSE 0 END) AS over_10pct FROM r GROUP BY state, date)
    SELECT *, 18 AS reserve_margin, greatest(60, 95 - mape * 1.2::DOUBLE) AS confidence, CASE WHEN peak_accuracy > 3 THEN 'warning' ELSE 'ok' END AS peak_status FROM d""")
def _(v):
    return ac.kpi_summary(v.pair)


_FK = ("mape:f rmse_mw:f bias_mw:f within_2pct:f ramp_within_2pct:f temperature_mw:f humidity_mw:f precipitation_mw:f unexplained_mw:f dips:i rises:i max_ramp:f " + " ".join(f"{n}_delta_mw:f" for n, _, _ in DELTA_WINDOWS)
       + " commitment_alignment_pct:f peak_temperature_mw:f peak_humidity_mw:f peak_precipitation_mw:f category block_error:i")


def full_input(v):
    f = v.pair.select("state", "date", "block", "forecast")
    return v.base.withColumnRenamed("load", "actual").join(f, ["state", "date", "block"])


@query("m5_full_kpis", "state date " + _FK, f"""
    WITH x AS (SELECT b.*, b.load AS actual, p.forecast, (temperature - n_temp) * 8 AS tm, (humidity - n_hum) * 2.5::DOUBLE AS hm, (precipitation - n_rain) * -4 AS pm FROM v_base b JOIN v_pair p USING (state, date, block)),
    r AS (SELECT *, abs(actual - forecast) / greatest(actual, 1e-6) AS r, (actual - baseline) / nullif(baseline, 0) * 100 AS pct, abs(actual - max(actual) OVER (PARTITION BY state, date ORDER BY block RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS rp FROM x),
    a AS (SELECT state, date, avg(r) * 100 AS mape, sqrt(avg((actual - forecast) ** 2)) AS rmse_mw, avg(forecast - actual) AS bias_mw, avg(CASE WHEN r <= 0.02 THEN 100.0::DOUBLE ELSE 0 END) AS within_2pct,
      avg(CASE WHEN r <= 0.02 THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE block BETWEEN 24 AND 43 OR block BETWEEN 64 AND 76) AS ramp_within_2pct, coalesce(sum(tm), 0) AS temperature_mw, coalesce(sum(hm), 0) AS humidity_mw, coalesce(sum(pm), 0) AS precipitation_mw,
      abs(sum(actual - baseline) - coalesce(sum(coalesce(tm, 0) + coalesce(hm, 0) + coalesce(pm, 0)), 0)) AS unexplained_mw, count(*) FILTER (WHERE pct <= -5) AS dips, count(*) FILTER (WHERE pct >= 5) AS rises, max(rp) AS max_ramp,
      {', '.join(f'coalesce(sum(actual - baseline) FILTER (WHERE {inw(lo, hi)}), 0) AS {n}_delta_mw' for n, lo, hi in DELTA_WINDOWS)}, max(actual) / (max(forecast) * 1.05::DOUBLE + 1e-6) * 100 AS commitment_alignment_pct,
      arg_max_null(tm, (actual, -block)) AS peak_temperature_mw, arg_max_null(hm, (actual, -block)) AS peak_humidity_mw, arg_max_null(pm, (actual, -block)) AS peak_precipitation_mw,
      abs(arg_max(block, (actual, -block)) - arg_max(block, (forecast, -block))) AS block_error FROM r GROUP BY state, date)
    SELECT *, CASE WHEN block_error = 0 THEN 'Exact match' WHEN block_error <= 2 THEN 'Close' WHEN block_error <= 4 THEN 'Moderate error' ELSE 'Poor' END AS category FROM a""")
def _(v):
    return ac.full_kpis(full_input(v))


_RDH = """rdx AS (SELECT t.state, t.date, t.h, k.date AS cand, (isodow(t.date) >= 6 OR t.date IN (SELECT holiday FROM v_hol)) = (isodow(k.date) >= 6 OR k.date IN (SELECT holiday FROM v_hol)) AS same
      FROM (SELECT DISTINCT state, date, h FROM v_load CROSS JOIN (VALUES (1), (2)) x(h)) t JOIN (SELECT DISTINCT state, date FROM v_load) k ON k.state = t.state AND k.date <= t.date - t.h AND k.date > t.date - t.h - 14),
    rdm AS (SELECT *, row_number() OVER (PARTITION BY state, date, h ORDER BY cand DESC) AS mr FROM rdx WHERE same), rdn AS (SELECT state, date, h, count(*) AS n FROM rdm WHERE mr <= 3 GROUP BY ALL),
    rdc AS (SELECT m.state, m.date, m.h, m.cand FROM rdm m JOIN rdn USING (state, date, h) WHERE mr <= 3 AND n >= 3
      UNION ALL SELECT x.state, x.date, x.h, x.cand FROM rdx x LEFT JOIN rdn USING (state, date, h) WHERE coalesce(n, 0) < 3 AND x.cand > x.date - x.h - 3),
    rdf AS (SELECT c.state, c.date, c.h, l.block, avg(l.load) AS f FROM rdc c JOIN v_load l ON l.state = c.state AND l.date = c.cand GROUP BY ALL),
    rob AS (SELECT 'seasonal_naive' AS model, x.h AS horizon, a.state, a.date, a.block, a.load AS actual, coalesce(b.load, r.f, d.load) AS forecast FROM v_load a CROSS JOIN (VALUES (1), (2)) x(h) LEFT JOIN v_load b ON b.state = a.state AND b.block = a.block AND b.date = a.date - 7
        LEFT JOIN rdf r ON r.state = a.state AND r.date = a.date AND r.block = a.block AND r.h = x.h LEFT JOIN v_load d ON d.state = a.state AND d.block = a.block AND d.date = a.date - x.h
      UNION ALL SELECT 'recent_day', x.h, a.state, a.date, a.block, a.load, coalesce(r.f, b.load, d.load) FROM v_load a CROSS JOIN (VALUES (1), (2)) x(h) LEFT JOIN rdf r ON r.state = a.state AND r.date = a.date AND r.block = a.block AND r.h = x.h
        LEFT JOIN v_load b ON b.state = a.state AND b.block = a.block AND b.date = a.date - 7 LEFT JOIN v_load d ON d.state = a.state AND d.block = a.block AND d.date = a.date - x.h),
    robx AS (SELECT * FROM rob WHERE date BETWEEN DATE '2024-01-15' AND DATE '2024-01-30')"""


@query("m6_rolling_origin_backtest", "state model horizon:i " + _MET, f"WITH {_RDH} " + met("robx", ["state", "model", "horizon"]))
def _(v):
    return bt.rolling_origin(v.grid, v.hol, "2024-01-15", "2024-01-30")

def _ridge(model, y, xs, base):
    """Forecasts of a ridge regression at every anchor in SQL: normal equations by Cramer's rule over each training span."""
    live = [f"v{i} > 1e-9" for i in range(3)]
    c = [[f"CASE WHEN {live[i]} THEN v{i} * (1 + 1.0::DOUBLE / n) ELSE 1.0::DOUBLE / n END" if i == j else f"CASE WHEN {live[i]} AND {live[j]} THEN c{min(i, j)}{max(i, j)} ELSE 0 END" for j in range(3)] for i in range(3)]
    named = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    beta = [_det([[f"y{i}" if col == j else named[i][col] for col in range(3)] for i in range(3)]) + f" / {_det(named)}" for j in range(3)]
    moments = ", ".join([f"avg({x}) AS a{i}, var_pop({x}) AS v{i}, covar_pop({x}, {y}) AS b{i}" for i, x in enumerate(xs)] + [f"covar_pop({xs[i]}, {xs[j]}) AS c{i}{j}" for i in range(3) for j in range(i + 1, 3)])
    matrix = ", ".join(f"{c[i][j]} AS m{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"CASE WHEN {live[i]} THEN b{i} ELSE 0 END AS y{i}" for i in range(3))
    left = "vy - 2 * (" + " + ".join(f"b{i}_ * y{i}" for i in range(3)) + ") + " + " + ".join(f"b{i}_ * b{j}_ * " + (f"CASE WHEN {live[i]} THEN v{i} ELSE 0 END" if i == j else named[i][j]) for i in range(3) for j in range(3))

    def fit(keys, min_rows):
        k = ", ".join(f"k.{c}" for c in keys)
        same = " AND ".join(f"r.{c} = k.{c}" for c in keys)
        return f"""SELECT *, sqrt(greatest({left}, 0)) AS sigma FROM (SELECT *, {', '.join(f'{b} AS b{j}_' for j, b in enumerate(beta))} FROM (SELECT *, {matrix} FROM (
          SELECT {k}, k.fit_week, count(*) AS n, avg({y}) AS ay, var_pop({y}) AS vy, {moments}
          FROM (SELECT DISTINCT {', '.join(keys)}, fit_week FROM fx WHERE fit_week >= 0) k JOIN fx r ON {same} AND r.train_week <= k.fit_week AND r.train_week > k.fit_week - 104
          WHERE residual IS NOT NULL AND dev_h IS NOT NULL AND dev_7d IS NOT NULL AND temp_change IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_rows})))"""

    def guess(m):
        return f"{base} + {m}.ay + " + " + ".join(f"{m}.b{i}_ * ({x} - {m}.a{i})" for i, x in enumerate(xs))

    ok = "CASE WHEN f IS NOT NULL THEN greatest(f{}, 0) END"
    return f"""SELECT '{model}' AS model, horizon, state, date, block, load AS actual, coalesce({ok.format('')}, reference) AS forecast, {ok.format(' - 1.2815515655446004::DOUBLE * sigma')} AS p10, {ok.format(' + 1.2815515655446004::DOUBLE * sigma')} AS p90, fit FROM (
      SELECT t.*, CASE WHEN m.n IS NOT NULL THEN {guess('m')} ELSE {guess('p')} END AS f, coalesce(m.sigma, p.sigma) AS sigma, CASE WHEN m.n IS NOT NULL THEN 'block' WHEN p.n IS NOT NULL THEN 'region' END AS fit
      FROM fx t LEFT JOIN ({fit(['state', 'block', 'horizon'], 10)}) m USING (state, block, horizon, fit_week) LEFT JOIN ({fit(['state', 'horizon'], 40)}) p USING (state, horizon, fit_week))"""


_FX = f"""{_RDH}, fx AS (
      SELECT *, load - reference AS residual, lag_h_load - reference AS dev_h, lag_7d_load - reference AS dev_7d, CAST(floor((date - DATE '2024-01-17') / 7.0) AS INTEGER) AS fit_week, CAST(ceil((date - DATE '2024-01-17' + horizon) / 7.0) AS INTEGER) AS train_week FROM (
        SELECT o.horizon, o.state, o.date, o.block, o.actual AS load, o.forecast AS reference, h.load AS lag_h_load, s.load AS lag_7d_load, w.temperature - u.temperature AS temp_change FROM rob o
        LEFT JOIN v_load h ON h.state = o.state AND h.block = o.block AND h.date = o.date - o.horizon LEFT JOIN v_load s ON s.state = o.state AND s.block = o.block AND s.date = o.date - 7
        LEFT JOIN v_wmean w ON w.state = o.state AND w.block = o.block AND w.date = o.date LEFT JOIN v_wmean u ON u.state = o.state AND u.block = o.block AND u.date = o.date - o.horizon
        WHERE o.model = 'recent_day')),
    ridged AS ({_ridge("ridge_residual", "residual", ["dev_h", "dev_7d", "temp_change"], "reference")} UNION ALL {_ridge("ridge_direct", "load", ["lag_h_load", "lag_7d_load", "temp_change"], "0")}),
    fitx AS (SELECT model, horizon, state, date, block, actual, forecast, p10, p90, CASE WHEN p10 IS NOT NULL THEN fit END AS fit FROM ridged WHERE date BETWEEN DATE '2024-01-17' AND DATE '2024-01-30'
      UNION ALL SELECT model, horizon, state, date, block, actual, forecast, NULL, NULL, NULL FROM rob WHERE date BETWEEN DATE '2024-01-17' AND DATE '2024-01-30')"""


@query("m6_fitted_backtest", "state model horizon:i " + _MET + " pinball_loss:f coverage_pct:f", f"""
    WITH {_FX}, q AS (SELECT state, model, horizon, avg((greatest(0.1::DOUBLE * (actual - p10), -0.9::DOUBLE * (actual - p10)) + greatest(0.5::DOUBLE * (actual - forecast), -0.5::DOUBLE * (actual - forecast)) + greatest(0.9::DOUBLE * (actual - p90), -0.1::DOUBLE * (actual - p90))) / 3) FILTER (WHERE p10 IS NOT NULL) AS pinball_loss,
      avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 100.0::DOUBLE ELSE 0 END) FILTER (WHERE p10 IS NOT NULL) AS coverage_pct FROM fitx WHERE actual IS NOT NULL AND forecast IS NOT NULL GROUP BY ALL)
    SELECT m.*, pinball_loss, coverage_pct FROM ({met("fitx", ["state", "model", "horizon"])}) m JOIN q USING (state, model, horizon)""")
def _(v):
    return refit.fitted_backtest(v.grid, v.wmean, v.hol, "2024-01-17", "2024-01-30")


@query("m6_fitted_forecasts", "state date block:i horizon:i model forecast:f p10:f p90:f fit", f"""
    WITH {_FX} SELECT state, date, block, horizon, model, forecast, p10, p90, fit FROM fitx WHERE model LIKE 'ridge%'""")
def _(v):
    return refit.fitted_forecasts(refit.supervised(v.grid, v.wmean, v.hol), "2024-01-17", "2024-01-30").where("actual is not null")


_BD = """bd AS (SELECT model, p.state, p.date, count(*) FILTER (WHERE ok) AS blocks, avg(r) FILTER (WHERE ok) * 100 AS mape, sqrt(avg((forecast - actual) ** 2) FILTER (WHERE ok)) AS rmse,
      sum(forecast - actual) FILTER (WHERE ok) / greatest(sum(actual) FILTER (WHERE ok), 4) * 100 AS energy_error_pct, avg(r) FILTER (WHERE ok AND block BETWEEN 49 AND 72) * 100 AS peak_mape, avg(temperature) AS avg_temp, max(actual) FILTER (WHERE ok) AS peak_load
      FROM (SELECT m.*, f.load AS actual, f.temperature, block > 36 AND f.load > 10 AND forecast IS NOT NULL AS ok, abs(forecast - f.load) / greatest(f.load, 1) AS r FROM v_fcm m LEFT JOIN v_frame f USING (state, date, block)) p GROUP BY ALL HAVING count(*) FILTER (WHERE ok) >= 10),
    bs AS (SELECT *, CASE WHEN isodow(date) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, CASE WHEN month(date) IN (3,4,5) THEN 'Summer' WHEN month(date) BETWEEN 6 AND 9 THEN 'Monsoon' WHEN month(date) IN (10,11) THEN 'Post-Monsoon' ELSE 'Winter' END AS season,
      CASE WHEN avg_temp IS NULL THEN 'Unknown' WHEN avg_temp >= 38 THEN 'Hot' WHEN avg_temp >= 25 THEN 'Warm' WHEN avg_temp >= 15 THEN 'Mild' ELSE 'Cold' END AS temp_regime,
      CASE WHEN avg_temp >= 38 THEN 'extreme' WHEN avg_temp >= 32 THEN 'high' WHEN avg_temp <= 15 THEN 'cold' ELSE 'normal' END AS weather_flag FROM bd)"""


def days(v):
    d = v.fcm.join(v.frame.select("state", "date", "block", F.col("load").alias("actual"), "temperature"), ["state", "date", "block"], "left")
    return ac.backtest_days(d)


@query("m7_backtest_days", "model state date blocks:i mape:f rmse:f energy_error_pct:f peak_mape:f peak_load:f day_type season temp_regime", f"WITH {_BD} SELECT * FROM bs")
def _(v):
    return days(v)


@query("m8_stratified_summary", "state model season day_type temp_regime n:i mape_mean:f mape_median:f rmse_mean:f peak_mape_mean:f", f"""
    WITH {_BD} SELECT state, model, season, day_type, temp_regime, count(*) AS n, avg(mape) AS mape_mean, median(mape) AS mape_median, avg(rmse) AS rmse_mean, avg(peak_mape) AS peak_mape_mean FROM bs
    GROUP BY GROUPING SETS ((state, model), (state, model, season), (state, model, day_type), (state, model, temp_regime))""")
def _(v):
    return ac.backtest_strata(days(v), ["state", "model"])


@query("m9_champion_challenger", "state n_days:i champion_mape:f challenger_mape:f improvement:f challenger_wins recommendation", f"""
    WITH {_BD}, p AS (SELECT state, date, max(mape) FILTER (WHERE model = 'lag7') AS a, max(mape) FILTER (WHERE model = 'lag1') AS b FROM bs GROUP BY ALL), s AS (SELECT state, count(*) AS n_days, avg(a) AS champion_mape, avg(b) AS challenger_mape FROM p WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY state)
    SELECT *, champion_mape - challenger_mape AS improvement, challenger_mape < champion_mape AS challenger_wins, CASE WHEN challenger_mape < champion_mape THEN 'promote_challenger' ELSE 'keep_champion' END AS recommendation FROM s""")
def _(v):
    return ac.champion_challenger(days(v), "lag7", "lag1")


@query("m10_live_accuracy", "state date current_mape:f settled_blocks:i longest_run:i drift_alert recalibrate worst_blocks", """
    WITH e AS (SELECT *, CASE WHEN actual > 10 AND forecast > 10 THEN abs(actual - forecast) / greatest(actual, 1) * 100 END AS ape FROM v_pair WHERE block <= 60), f AS (SELECT *, coalesce(ape > 5, false) AS bad FROM e),
    g AS (SELECT *, block - row_number() OVER (PARTITION BY state, date, bad ORDER BY block) AS grp FROM f), r AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY state, date, bad, grp ORDER BY block) AS run FROM g)
    SELECT state, date, avg(ape) AS current_mape, count(*) AS settled_blocks, max(run) AS longest_run, max(run) >= 8 AS drift_alert, max(run) >= 8 AND count(*) < 72 AS recalibrate,
      coalesce(array_to_string(list_transform(list_slice(list(block ORDER BY ape DESC, block) FILTER (WHERE ape IS NOT NULL), 1, 3), lambda x: CAST(x AS VARCHAR)), ','), '') AS worst_blocks FROM r GROUP BY state, date""")
def _(v):
    return ac.live_accuracy(v.pair, settled=60)


@query("m11_model_performance", "state model date rolling_mape:f prior_mape:f drift best_day worst_day", f"""
    WITH {_BD}, x AS (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) AS dn FROM bs),
    r AS (SELECT state, model, date, avg(mape) OVER (w RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_mape, avg(mape) OVER (w RANGE BETWEEN 13 PRECEDING AND 7 PRECEDING) AS prior_mape FROM x WINDOW w AS (PARTITION BY state, model ORDER BY dn)),
    e AS (SELECT state, model, arg_min(date, (mape, date)) AS best_day, arg_max(date, (mape, -(date - DATE '1970-01-01'))) AS worst_day FROM bs GROUP BY ALL)
    SELECT r.*, coalesce(rolling_mape > 1.2::DOUBLE * prior_mape, false) AS drift, best_day, worst_day FROM r JOIN e USING (state, model)""")
def _(v):
    return ac.model_performance(days(v))


@query("m12_history_trend", "state first_half:f second_half:f improvement_pct:f bias_improving", """
    WITH d AS (SELECT state, date, avg(abs(actual - forecast) / greatest(actual, 1e-6)) * 100 AS mape, avg(forecast - actual) AS bias, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM v_pair GROUP BY state, date),
    n AS (SELECT *, r <= count(*) OVER (PARTITION BY state) - greatest(count(*) OVER (PARTITION BY state) // 2, 1) AS second FROM d WHERE r <= 14),
    s AS (SELECT state, avg(mape) FILTER (WHERE NOT second) AS first_half, avg(mape) FILTER (WHERE second) AS second_half, avg(bias) FILTER (WHERE NOT second) AS b1, avg(bias) FILTER (WHERE second) AS b2 FROM n GROUP BY state)
    SELECT state, first_half, second_half, (first_half - second_half) / first_half * 100 AS improvement_pct, b2 - b1 < 0 AS bias_improving FROM s""")
def _(v):
    return ac.history_trend(ac.kpi_summary(v.pair))


@query("m13_psi_drift", "state psi:f", f"""
    WITH {_BD}, d AS (SELECT state, mape, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM bs WHERE model = 'lag7'), k AS (SELECT *, max(mape) OVER (PARTITION BY state) AS mx FROM d WHERE r <= 14),
    b AS (SELECT state, least(CAST(floor(mape / ((mx + 1e-6) / 5)) AS BIGINT) + 1, 5) AS bin, r <= 7 AS nw FROM k), t AS (SELECT state, count(*) FILTER (WHERE nw) AS rt, count(*) FILTER (WHERE NOT nw) AS bt FROM b GROUP BY state),
    c AS (SELECT t.state, x.bin, rt, bt, count(*) FILTER (WHERE nw) AS r, count(*) FILTER (WHERE NOT nw) AS o FROM t CROSS JOIN (SELECT unnest(range(1, 6)) AS bin) x LEFT JOIN b ON b.state = t.state AND b.bin = x.bin GROUP BY ALL),
    p AS (SELECT state, CASE WHEN r = 0 THEN 1e-4 ELSE r * 1.0::DOUBLE / greatest(rt, 1) END AS a, CASE WHEN o = 0 THEN 1e-4 ELSE o * 1.0::DOUBLE / greatest(bt, 1) END AS b FROM c)
    SELECT state, greatest(0, sum((a - b) * ln(a / b))) AS psi FROM p GROUP BY state""")
def _(v):
    return ac.psi_drift(days(v).where("model = 'lag7'"))


@query("m14_demand_response", "state threshold:f tp:i tn:i fp:i fn:i accuracy_pct:f", """
    WITH d AS (SELECT state, date, max(actual) AS ap, max(forecast) AS fp, row_number() OVER (PARTITION BY state ORDER BY date DESC) AS r FROM v_pair GROUP BY state, date), t AS (SELECT *, quantile_cont(ap, 0.8) OVER (PARTITION BY state) AS th FROM d WHERE r <= 14)
    SELECT state, max(th) AS threshold, count(*) FILTER (WHERE fp > th AND ap > th) AS tp, count(*) FILTER (WHERE fp <= th AND ap <= th) AS tn, count(*) FILTER (WHERE fp > th AND ap <= th) AS fp, count(*) FILTER (WHERE fp <= th AND ap > th) AS fn,
      count(*) FILTER (WHERE (fp > th) = (ap > th)) * 100.0::DOUBLE / count(*) AS accuracy_pct FROM t GROUP BY state""")
def _(v):
    return ac.demand_response(v.pair, q=0.8)


@query("m15_peak_time", "state date actual_peak_block:i forecast_peak_block:i block_error:i category", """
    WITH d AS (SELECT state, date, arg_max(block, (actual, -block)) AS actual_peak_block, arg_max(block, (forecast, -block)) AS forecast_peak_block FROM v_pair GROUP BY state, date)
    SELECT *, abs(actual_peak_block - forecast_peak_block) AS block_error, CASE WHEN abs(actual_peak_block - forecast_peak_block) = 0 THEN 'Exact match' WHEN abs(actual_peak_block - forecast_peak_block) <= 2 THEN 'Close' WHEN abs(actual_peak_block - forecast_peak_block) <= 4 THEN 'Moderate error' ELSE 'Poor' END AS category FROM d""")
def _(v):
    return ac.peak_time(v.pair)


@query("m16_financials", "state date energy_cost_variance:f capacity_efficiency:f ancillary_cost:f fuel_cost_variance:f", """
    SELECT state, date, abs(sum(actual) - sum(forecast)) * 80 AS energy_cost_variance, 100 - abs(max(forecast) - max(actual)) * 5 / (max(forecast) * 5 + 1e-6) * 100 AS capacity_efficiency, abs(max(forecast) - max(actual)) * 10 AS ancillary_cost,
      abs(max(forecast) - max(actual)) * 50 AS fuel_cost_variance FROM v_pair GROUP BY state, date""")
def _(v):
    return ac.financials(v.pair)


@query("m17_block_errors", "state block:i mape:f bias:f std:f n:i", """
    SELECT state, block, avg(abs(actual - forecast) / greatest(actual, 1e-6)) * 100 AS mape, avg(forecast - actual) AS bias, stddev_samp(forecast - actual) AS std, count(*) AS n FROM v_pair GROUP BY state, block""")
def _(v):
    return ac.block_errors(v.pair)


@query("m17_recommendations", "state rule:i text value:f", """
    WITH b AS (SELECT state, block, avg(abs(actual - forecast) / greatest(actual, 1e-6)) * 100 AS mape, avg(forecast - actual) AS bias, stddev_samp(forecast - actual) AS std FROM v_pair GROUP BY state, block),
    s AS (SELECT state, avg(bias) AS bias, avg(mape) AS mape, avg(mape) FILTER (WHERE block BETWEEN 48 AND 72) AS pm, avg(mape) FILTER (WHERE block <= 24) AS nm, avg(std) AS std FROM b GROUP BY state)
    SELECT state, 1 AS rule, 'systematic over-forecast' AS text, bias AS value FROM s WHERE bias > 0.02 * std UNION ALL SELECT state, 2, 'systematic under-forecast', bias FROM s WHERE bias < -0.02 * std
    UNION ALL SELECT state, 3, 'peak blocks above average error', pm FROM s WHERE pm > mape UNION ALL SELECT state, 4, 'night blocks above average error', nm FROM s WHERE nm > mape""")
def _(v):
    return ac.recommendations(v.pair)


@query("m18_blend_search", "state weight:f mape:f", """
    WITH p AS (SELECT a.state, a.date, a.block, l.load AS actual, a.forecast AS fa, b.forecast AS fb FROM v_fcm a JOIN v_fcm b USING (state, date, block) JOIN v_load l USING (state, date, block) WHERE a.model = 'lag7' AND b.model = 'lag1' AND l.load > 10)
    SELECT state, w / 10.0::DOUBLE AS weight, avg(abs(actual - (w / 10.0::DOUBLE * fa + (1 - w / 10.0::DOUBLE) * fb)) / actual) * 100 AS mape FROM p CROSS JOIN (SELECT unnest(range(0, 11)) AS w) GROUP BY state, w""")
def _(v):
    return ac.blend_search(v.fcm.join(v.load.withColumnRenamed("load", "actual"), ["state", "date", "block"]), "lag7", "lag1")


@query("m19_segment_root_cause", "state date segment mape:f bias:f under_pct:f is_worst reason", f"""
    WITH {_CTX}, cf AS (SELECT state, date, concat_ws(' ', {_fac('Heat', 'temp_max', 38, 3, 'C')}, {_fac('Humidity', 'hum_mean', 70, 8, '%')}, {_fac('Heat-index', 'heat_proxy', 60, 7, '')}, {_fac('Rain', 'rain_sum', 1, 1, ' mm')}, {_fac('Wind', 'wind_max', 18, 5, '')}) AS f FROM cz),
    s AS (SELECT state, date, {part(ac.SEGMENTS)} AS segment, avg(abs(actual - forecast) / greatest(actual, 1e-6)) * 100 AS mape, avg(forecast - actual) AS bias, avg(CASE WHEN forecast < actual THEN 100.0::DOUBLE ELSE 0 END) AS under_pct FROM v_pair GROUP BY ALL),
    w AS (SELECT *, row_number() OVER (PARTITION BY state, date ORDER BY mape DESC, segment) = 1 AS is_worst FROM s)
    SELECT w.*, concat_ws(' ', CASE WHEN under_pct >= 65 THEN 'Persistent under-forecast.' WHEN under_pct <= 35 THEN 'Persistent over-forecast.' ELSE 'Mixed error direction.' END, CASE WHEN is_worst THEN 'Worst segment: ' || segment || '.' END,
      CASE WHEN f = '' THEN 'No clear abnormal weather factor.' ELSE f END) AS reason FROM w LEFT JOIN cf USING (state, date)""")
def _(v):
    c = wx.daily_context(v.frame)
    return ac.segment_root_cause(v.pair, c.select("state", "date", wx.abnormal_factor(c).alias("factors")))


@query("m20_skill_score", "state date model_mape:f persistence_mape:f skill_pct:f bias:f", """
    WITH d AS (SELECT p.state, p.date, avg(abs(forecast - actual) / actual) * 100 AS model_mape, avg(abs(y.load - actual) / actual) * 100 AS persistence_mape, count(*) AS n, avg(forecast - actual) AS bias FROM v_pair p JOIN v_load y ON y.state = p.state AND y.block = p.block AND y.date = p.date - 1
      WHERE actual > 10 GROUP BY p.state, p.date HAVING count(*) >= 10) SELECT *, (persistence_mape - model_mape) / persistence_mape * 100 AS skill_pct FROM d""")
def _(v):
    y = v.load.select("state", F.date_add("date", 1).alias("date"), "block", F.col("load").alias("persistence"))
    return ac.skill_score(v.pair.join(y, ["state", "date", "block"], "left"))


@query("m21_backtest_summary", "state model n_days:i mape_mean:f mape_median:f mape_min:f mape_max:f mape_p90:f rmse_mean:f energy_error_mean:f peak_mape_mean:f days_under_3pct:i days_under_5pct:i weekend_mape:f weekday_mape:f", f"""
    WITH {_BD} SELECT state, model, count(*) AS n_days, avg(mape) AS mape_mean, median(mape) AS mape_median, min(mape) AS mape_min, max(mape) AS mape_max, quantile_cont(mape, 0.9) AS mape_p90, avg(rmse) AS rmse_mean, avg(energy_error_pct) AS energy_error_mean, avg(peak_mape) AS peak_mape_mean,
      count(*) FILTER (WHERE mape < 3) AS days_under_3pct, count(*) FILTER (WHERE mape < 5) AS days_under_5pct, avg(mape) FILTER (WHERE day_type = 'Weekend') AS weekend_mape, avg(mape) FILTER (WHERE day_type <> 'Weekend') AS weekday_mape FROM bs GROUP BY state, model""")
def _(v):
    return ac.backtest_summary(days(v), ["state", "model"])


@query("m22_day_type_match", "state date match_quality:f", """
    WITH p AS (SELECT state, is_weekend, block, avg(load) AS p FROM v_cal GROUP BY ALL) SELECT c.state, c.date, 1 - avg(abs(load - p) / greatest(load, 1e-6)) AS match_quality FROM v_cal c JOIN p USING (state, is_weekend, block) GROUP BY c.state, c.date""")
def _(v):
    return ac.day_type_match(v.cal)


@query("m23_horizon_comparison", "state date t1_mape:f t1_accuracy:f t1_peak_mape:f t2_mape:f t2_accuracy:f t2_peak_mape:f", """
    WITH p AS (SELECT a.state, a.date, a.block, x.h, a.load AS actual, b.load AS forecast FROM v_load a CROSS JOIN (VALUES (1), (2)) x(h) LEFT JOIN v_load b ON b.state = a.state AND b.block = a.block AND b.date = a.date - x.h),
    r AS (SELECT *, abs(forecast - actual) / greatest(actual, 1) * 100 AS r FROM p WHERE actual > 10)
    SELECT d.state, d.date, avg(r) FILTER (WHERE h = 1) AS t1_mape, 100 - avg(r) FILTER (WHERE h = 1) AS t1_accuracy, avg(r) FILTER (WHERE h = 1 AND block BETWEEN 48 AND 72) AS t1_peak_mape, avg(r) FILTER (WHERE h = 2) AS t2_mape, 100 - avg(r) FILTER (WHERE h = 2) AS t2_accuracy,
      avg(r) FILTER (WHERE h = 2 AND block BETWEEN 48 AND 72) AS t2_peak_mape FROM (SELECT DISTINCT state, date FROM v_load) d LEFT JOIN r USING (state, date) GROUP BY d.state, d.date""")
def _(v):
    d = v.load.select("state", "date", "block", F.col("load").alias("actual"), day_lag("load", 1).alias("f1"), day_lag("load", 2).alias("f2"))
    d = d.select("state", "date", "block", "actual", F.explode(F.array(F.struct(F.lit(1).alias("horizon"), F.col("f1").alias("forecast")), F.struct(F.lit(2).alias("horizon"), F.col("f2").alias("forecast")))).alias("x")).select("state", "date", "block", "actual", "x.*")
    return ac.horizon_comparison(d)


@query("m24_day_weather_flag", "model state date weather_flag", f"WITH {_BD} SELECT * FROM bs")
def _(v):
    return days(v)


@query("m25_windowed_quality", "state expected_blocks:i present_blocks:i missing_dates:i status", """
    WITH d AS (SELECT state, date, count(DISTINCT block) AS n, count(*) FILTER (WHERE value <= 0) AS np FROM v_ev WHERE date BETWEEN DATE '2024-01-16' AND DATE '2024-01-25' GROUP BY ALL),
    s AS (SELECT l.state, 960 AS expected_blocks, coalesce(sum(n), 0) AS present_blocks, 10 - count(n) AS missing_dates FROM (SELECT DISTINCT state FROM v_load) l LEFT JOIN d USING (state) GROUP BY l.state)
    SELECT *, CASE WHEN present_blocks < 480 THEN 'failed' WHEN present_blocks < 950.4 OR missing_dates > 0 THEN 'degraded' ELSE 'ok' END AS status FROM s""")
def _(v):
    from quarterhour.operators.quality import load_contract
    rows = v.ev.select("state", "date", "block", F.col("value").alias("load"))
    return load_contract(rows, "2024-01-16", "2024-01-25", rows.select("state").distinct())
