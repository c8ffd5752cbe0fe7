"""2.N attribution, drivers and what-if tables."""

from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.catalog.core import query
from quarterhour.catalog.j_weather import _IMP
from quarterhour.catalog.sqlparts import ols, slope, spearman
from quarterhour.operators import attribution as at
from quarterhour.operators import regress as rg
from quarterhour.operators import scenarios as sc
from quarterhour.operators import weather as wx
from quarterhour.operators.features import day_context

SCEN = "('hot', 3.0, 5.0, 0, 0, 0, 0), ('storm', -2.0, 25.0, 1, 0, 0, 0), ('holiday', 0.0, 0.0, 0, 1, 1, 0), ('friday', 1.0, -4.0, 0, 0, 0, 1)"
_SC = f"sc AS (SELECT scenario_id, td::DOUBLE AS td, hd::DOUBLE AS hd, rn, we, ho, pw FROM (VALUES {SCEN}) t(scenario_id, td, hd, rn, we, ho, pw))"


def scen(v):
    rows = SCEN
    return dims.values_frame(v.spark, "scenario_id, temp_delta, hum_delta, is_raining, is_weekend, is_holiday, is_pre_weekend", rows)


@query("n1_attribution_shares", "state date factor value:f pct:f", """
    WITH a AS (SELECT state, date, coalesce(sum((temperature - n_temp) * 8), 0) AS t, coalesce(sum((humidity - n_hum) * 2.5::DOUBLE), 0) AS h, coalesce(sum((precipitation - n_rain) * -4), 0) AS p, coalesce(sum(load - baseline), 0) AS total FROM v_base GROUP BY state, date),
    b AS (SELECT *, CASE WHEN abs(t + h + p) > 1e-6 THEN t + h + p ELSE 1 END AS d FROM a)
    SELECT state, date, 'temperature' AS factor, t AS value, t / d * 100 AS pct FROM b UNION ALL SELECT state, date, 'humidity', h, h / d * 100 FROM b UNION ALL SELECT state, date, 'precipitation', p, p / d * 100 FROM b
    UNION ALL SELECT state, date, 'unexplained', total - t - h - p, (total - t - h - p) / d * 100 FROM b""")
def _(v):
    return at.attribution_shares(v.base)


@query("n2_weather_index", "state date block:i wsi:f", "SELECT state, date, block, CASE WHEN abs(baseline) > 1e-6 THEN (load - baseline) / abs(baseline) * 100 ELSE 0 END AS wsi FROM v_base")
def _(v):
    return at.weather_index(v.base)


@query("n3_block_attribution", "state date block:i total_variance:f temperature_mw:f humidity_mw:f precipitation_mw:f unexplained_mw:f", """
    SELECT state, date, block, load - baseline AS total_variance, (temperature - n_temp) * 8 AS temperature_mw, (humidity - n_hum) * 2.5::DOUBLE AS humidity_mw, (precipitation - n_rain) * -4 AS precipitation_mw,
      load - baseline - (coalesce((temperature - n_temp) * 8, 0) + coalesce((humidity - n_hum) * 2.5::DOUBLE, 0) + coalesce((precipitation - n_rain) * -4, 0)) AS unexplained_mw FROM v_base""")
def _(v):
    return at.block_attribution(v.base)


_SL = "('a', 1.0, 1.0, 1.0, 1.0, 1, 96), ('b', 1.5, 0.5, 2.0, 0.0, 30, 60), ('c', 0.8, 1.2, -1.0, 1.0, 70, 90)"


@query("n4_driver_matrix", "scenario_id state date block:i impact:f mask:f baseline_mw:f final_mw:f", f"""
    WITH s AS (SELECT id, sw::DOUBLE AS sw, st::DOUBLE AS st, sh::DOUBLE AS sh, sd::DOUBLE AS sd, lo, hi FROM (VALUES {_SL}) t(id, sw, st, sh, sd, lo, hi)),
    x AS (SELECT id, b.*, least(greatest(coalesce((temperature - n_temp) * 0.012::DOUBLE * st * sw, 0) + coalesce((humidity - n_hum) * 0.002::DOUBLE * sh * sw, 0) + coalesce(CASE WHEN is_weekend = 1 THEN -0.08::DOUBLE ELSE 0 END * sd, 0), -0.4), 0.5) AS impact,
      CASE WHEN block BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END AS mask FROM v_base b CROSS JOIN s)
    SELECT id AS scenario_id, state, date, block, impact, mask, baseline AS baseline_mw, baseline * (1 + impact * mask) AS final_mw FROM x""")
def _(v):
    s = dims.values_frame(v.spark, "scenario_id, s_weather, s_temperature, s_humidity, s_daytype, b_lo, b_hi", _SL)
    rows = v.base.withColumns({"temperature_base": (F.col("temperature") - F.col("n_temp")) * 0.012, "humidity_base": (F.col("humidity") - F.col("n_hum")) * 0.002,
                               "daytype_base": F.when(F.col("is_weekend") == 1, -0.08).otherwise(0.0)})
    return at.driver_matrix(rows, s, ["temperature", "humidity", "daytype"])


@query("n5_weight_delta_engine", "state date block:i temperature_base:f humidity_base:f impact:f final_mw:f", f"""
    WITH w AS (SELECT state, block, {slope('load', 'temperature')} / avg(load) AS tw, {slope('load', 'humidity')} / avg(load) AS hw FROM v_frame GROUP BY ALL), o AS (SELECT * FROM (VALUES ('ALL', 50, 0.05::DOUBLE), ('R1', 51, -0.1::DOUBLE)) t(state, block, ov)),
    x AS (SELECT b.*, coalesce(ov, (temperature - n_temp) * tw, 0) AS temperature_base, coalesce((humidity - n_hum) * hw, 0) AS humidity_base FROM v_base b LEFT JOIN w USING (state, block) LEFT JOIN o USING (state, block)),
    y AS (SELECT *, least(greatest(temperature_base + humidity_base, -0.4), 0.5) AS impact FROM x) SELECT *, baseline * (1 + impact) AS final_mw FROM y""")
def _(v):
    from quarterhour.functions.stats import slope as sl
    w = v.frame.groupBy("state", "block").agg((sl("load", "temperature") / F.avg("load")).alias("temperature_weight"), (sl("load", "humidity") / F.avg("load")).alias("humidity_weight"))
    o = dims.values_frame(v.spark, "state, block, temperature_override", "('ALL', 50, 0.05D), ('R1', 51, -0.1D)")
    return at.weighted_deltas(v.base, w, ["temperature", "humidity"], o)


_PARTS = {"temperature": "temperature_mw", "humidity": "humidity_mw", "precipitation": "precipitation_mw"}
_CON = "cn AS (SELECT *, (temperature - n_temp) * 8 AS tm, (humidity - n_hum) * 2.5::DOUBLE AS hm, (precipitation - n_rain) * -4 AS pm FROM v_base)"


@query("n6_ranked_contributors", "state date block:i feature mw:f share_pct:f load_pct:f direction rank:i", f"""
    WITH {_CON}, l AS (SELECT state, date, block, baseline, 'temperature' AS feature, coalesce(tm, 0) AS mw FROM cn UNION ALL SELECT state, date, block, baseline, 'humidity', coalesce(hm, 0) FROM cn UNION ALL SELECT state, date, block, baseline, 'precipitation', coalesce(pm, 0) FROM cn),
    t AS (SELECT *, sum(abs(mw)) OVER (PARTITION BY state, date, block) AS tot FROM l)
    SELECT state, date, block, feature, mw, mw / CASE WHEN tot > 0 THEN tot ELSE 1 END * 100 AS share_pct, mw / nullif(baseline, 0) * 100 AS load_pct, CASE WHEN mw >= 0 THEN 'up' ELSE 'down' END AS direction,
      row_number() OVER (PARTITION BY state, date, block ORDER BY abs(mw) DESC, feature) AS rank FROM t""")
def _(v):
    return at.ranked_contributors(at.contributions(v.base), _PARTS)


@query("n6_risk_actions", "state date block:i net_impact_pct:f risk_score:f risk_flag dominant action", f"""
    WITH {_CON}, x AS (SELECT *, coalesce((load - baseline) / nullif(abs(baseline), 0) * 100, 0) AS net_impact_pct, abs(coalesce(tm, 0)) AS aw, abs(coalesce(CASE WHEN is_weekend = 1 THEN -20.0::DOUBLE ELSE 0 END, 0)) AS ac FROM cn),
    y AS (SELECT *, least(100, abs(net_impact_pct) * 2 + 10) AS risk_score, CASE WHEN ac > aw THEN 'calendar' ELSE 'weather' END AS dominant FROM x),
    f AS (SELECT *, CASE WHEN risk_score >= 60 THEN 'high' WHEN risk_score >= 30 THEN 'medium' ELSE 'low' END AS risk_flag FROM y)
    SELECT *, CASE WHEN risk_flag = 'high' THEN CASE WHEN dominant = 'weather' THEN 'Increase reserve and monitor weather-driven slots.' ELSE 'Review day-type/holiday assumptions before commitment.' END
      WHEN risk_flag = 'medium' THEN 'Monitor slot and pre-position balancing support.' WHEN abs(net_impact_pct) >= 8 THEN 'Keep slot under watch; no immediate intervention.' ELSE 'No action required.' END AS action FROM f""")
def _(v):
    d = at.contributions(v.base).withColumn("calendar_mw", F.when(F.col("is_weekend") == 1, -20.0).otherwise(0.0))
    return at.risk_actions(d, {"weather": "temperature_mw", "calendar": "calendar_mw"}, F.lit(10.0), final="load")


@query("n7_driver_shares", "state date driver mw:f share_pct:f", f"""
    WITH {_CON}, a AS (SELECT state, date, coalesce(avg(tm), 0) AS t, coalesce(avg(hm), 0) AS h, coalesce(avg(pm), 0) AS p FROM cn WHERE block > 36 GROUP BY state, date), b AS (SELECT *, CASE WHEN abs(t) + abs(h) + abs(p) > 0 THEN abs(t) + abs(h) + abs(p) ELSE 1 END AS d FROM a)
    SELECT state, date, 'temperature' AS driver, t AS mw, t / d * 100 AS share_pct FROM b UNION ALL SELECT state, date, 'humidity', h, h / d * 100 FROM b UNION ALL SELECT state, date, 'precipitation', p, p / d * 100 FROM b""")
def _(v):
    return at.driver_shares(at.contributions(v.base), _PARTS, 36)


_T = "((block - 1) / 95.0::DOUBLE)"
_SHAPE = f"least(greatest(0.78::DOUBLE + 0.52::DOUBLE * exp(-pow({_T} - 0.42::DOUBLE, 2) / 0.012::DOUBLE) + 0.74::DOUBLE * exp(-pow({_T} - 0.78::DOUBLE, 2) / 0.01::DOUBLE) - 0.16::DOUBLE * exp(-pow({_T} - 0.08::DOUBLE, 2) / 0.03::DOUBLE), 0.6), 1.6)"


@query("n8_weather_impact_table", "state date block:i season time_multiplier:f raw_pct:f weather_pct:f", f"""
    WITH c AS (SELECT season, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM (VALUES {sc.WEATHER_COEFFS}) t(season, a, b, c, d)),
    x AS (SELECT state, date, block, c.season, {_SHAPE} AS time_multiplier, (temperature - n_temp) * a + (humidity - n_hum) / 10 * b + (precipitation - n_rain) / 10 * c + 0.5::DOUBLE * d AS raw_pct FROM v_base CROSS JOIN c WHERE c.season = 'winter' AND n_temp IS NOT NULL AND temperature IS NOT NULL)
    SELECT *, least(greatest(raw_pct * time_multiplier, -15), 15) AS weather_pct FROM x""")
def _(v):
    c = dims.values_frame(v.spark, "season, c_temp, c_hum, c_rain, c_wind", sc.WEATHER_COEFFS)
    d = v.base.where("n_temp is not null and temperature is not null").select("state", "date", "block", F.lit("winter").alias("season"), (F.col("temperature") - F.col("n_temp")).alias("d_temp"),
                                                                             (F.col("humidity") - F.col("n_hum")).alias("d_hum"), (F.col("precipitation") - F.col("n_rain")).alias("d_rain"), F.lit(0.5).alias("d_wind"))
    return sc.weather_impact_table(d, c)


@query("n9_temperature_steps", "state date block:i temp_delta:f after_season:f after_time:f after_comfort:f raw_impact:f impact_pct:f", f"""
    WITH e AS (SELECT season, k::DOUBLE AS k, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES {sc.TEMP_ELASTICITY}) t(season, k, lo, hi)),
    x AS (SELECT state, date, block, temperature AS tq, temperature - n_temp AS temp_delta, (temperature - n_temp) * k AS after_season, (temperature - n_temp) * k * {_SHAPE} AS after_time, lo, hi FROM v_base JOIN e ON e.season = 'winter' WHERE n_temp IS NOT NULL AND temperature IS NOT NULL),
    y AS (SELECT *, after_time * CASE WHEN tq BETWEEN lo AND hi THEN 0.85::DOUBLE ELSE least(1.5, 1 + 0.05::DOUBLE * CASE WHEN tq < lo THEN lo - tq ELSE tq - hi END) END AS after_comfort FROM x),
    z AS (SELECT *, after_comfort * ((0.5::DOUBLE * 1.2::DOUBLE + 0.3::DOUBLE * 1.0::DOUBLE + 0.2::DOUBLE * 0.55::DOUBLE) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE)) AS raw_impact FROM y) SELECT *, least(greatest(raw_impact, -25), 25) AS impact_pct FROM z""")
def _(v):
    e = dims.values_frame(v.spark, "season, elasticity, band_lo, band_hi", sc.TEMP_ELASTICITY)
    rows = v.base.where("n_temp is not null and temperature is not null").select("state", "date", "block", F.lit("winter").alias("season"), F.col("n_temp").alias("base_temp"), F.col("temperature").alias("adjusted_temp"))
    return sc.temperature_steps(rows, e, {"residential": 0.5, "commercial": 0.3, "industrial": 0.2})


_P6 = """q6 AS (SELECT *, temperature - avg(temperature) OVER w AS dt, (load - avg(load) OVER w) / nullif(avg(load) OVER w, 0) AS dl FROM v_t WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)),
    s6 AS (SELECT state, block, CASE WHEN dt > 0 THEN 'up' ELSE 'down' END AS direction, dl / dt AS slope FROM q6 WHERE abs(dt) >= 0.5 AND dl IS NOT NULL),
    i6 AS (SELECT *, quantile_cont(slope, 0.25) OVER w AS a, quantile_cont(slope, 0.75) OVER w AS b FROM s6 WINDOW w AS (PARTITION BY state, block, direction)),
    m6 AS (SELECT state, block, direction, median(slope) AS median_slope, count(*) AS n FROM i6 WHERE slope BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY ALL),
    p6 AS (SELECT *, n / (n + 20.0::DOUBLE) * median_slope + (1 - n / (n + 20.0::DOUBLE)) * CASE WHEN direction = 'up' THEN 0.01::DOUBLE ELSE 0.008::DOUBLE END AS coefficient FROM m6)"""


@query("n10_adaptive_temperature_base", "state date block:i effective_coeff:f temperature_base:f", f"""
    WITH {_P6}, c AS (SELECT state, block, max(coefficient) FILTER (WHERE direction = 'up') AS u, max(coefficient) FILTER (WHERE direction = 'down') AS d FROM p6 GROUP BY ALL),
    x AS (SELECT b.*, temperature - n_temp AS dt, CASE WHEN temperature - n_temp >= 0 THEN coalesce(u, 0.01) ELSE coalesce(d, 0.01) END AS k FROM v_base b LEFT JOIN c USING (state, block) WHERE temperature IS NOT NULL AND n_temp IS NOT NULL),
    y AS (SELECT *, CASE WHEN temperature >= 26 THEN k * 0.35::DOUBLE ELSE k END * CASE WHEN temperature BETWEEN 18 AND 24 THEN 0.85::DOUBLE ELSE least(1.6, 1 + 0.05::DOUBLE * CASE WHEN temperature < 18 THEN 18 - temperature ELSE temperature - 24 END) END AS effective_coeff FROM x)
    SELECT *, least(greatest(dt * effective_coeff, -0.25), 0.25) AS temperature_base FROM y""")
def _(v):
    e = dims.values_frame(v.spark, "season, elasticity, band_lo, band_hi", sc.TEMP_ELASTICITY)
    return sc.adaptive_temperature_base(v.base.where("temperature is not null and n_temp is not null"), rg.temperature_steps(v.frame), e, "winter")


_SENS = f"""mm AS (SELECT *, coalesce(temperature, avg(temperature) OVER (PARTITION BY state)) AS tq, coalesce(humidity, avg(humidity) OVER (PARTITION BY state)) AS hq FROM v_frame), ob AS ({ols('mm', 'load', ['tq', 'hq'], 'state', 3)}),
    sa AS (SELECT state, avg(load) AS base_load, coalesce(avg(load) FILTER (WHERE precipitation <= 0.5) - avg(load) FILTER (WHERE precipitation > 0.5), 0) AS rain_dip, avg(load) FILTER (WHERE is_weekend = 0) AS wd, avg(load) FILTER (WHERE is_weekend = 1) AS wk,
      avg(load) FILTER (WHERE is_holiday = 1) AS hl, avg(load) FILTER (WHERE dow = 4) AS fr, avg(load) FILTER (WHERE dow = 0) AS mo FROM v_frame GROUP BY state),
    ss AS (SELECT sa.*, coalesce(beta_tq, 0) AS tb, coalesce(beta_hq, 0) AS hb FROM sa LEFT JOIN ob USING (state)), {_SC},
    sx AS (SELECT ss.*, sc.*, tb * td AS tpart, hb * hd AS hpart, rn * rain_dip AS rpart, -we * coalesce(wd - wk, 0) - ho * coalesce(wd - hl, 0) + pw * coalesce(fr - wd, 0) AS cpart FROM ss CROSS JOIN sc)"""
_ADJ = "('hot', 40, 12.5), ('hot', 41, -3.0), ('storm', 70, 8.0)"


@query("n11_deviation_curves", "state scenario_id block:i baseline_mw:f simulated_mw:f deviation_mw:f", f"""
    WITH {_SENS}, p AS (SELECT state, block, avg(load) AS b FROM v_frame GROUP BY ALL), f AS (SELECT state, arg_min(b, block) AS f FROM p GROUP BY state), ad AS (SELECT * FROM (VALUES {_ADJ}) t(scenario_id, block, dm)),
    x AS (SELECT p.state, sx.scenario_id, p.block, p.b AS baseline_mw, coalesce(q.b, f) + tpart + hpart - rpart + cpart + coalesce(dm, 0) AS simulated_mw FROM sx JOIN p USING (state) JOIN f USING (state)
      LEFT JOIN p q ON q.state = p.state AND q.block = p.block - CASE WHEN hd > 0 THEN CAST(floor(hd / 10) AS INTEGER) ELSE 0 END LEFT JOIN ad ON ad.scenario_id = sx.scenario_id AND ad.block = p.block)
    SELECT *, simulated_mw - baseline_mw AS deviation_mw FROM x""")
def _(v):
    adj = dims.values_frame(v.spark, "scenario_id, block, delta_mw", _ADJ)
    return sc.deviation_what_if(v.frame_once, scen(v), adj)


@query("n11_deviation_summary", "state scenario_id deviation_mw:f deviation_pct:f stress_class temperature_pct:f humidity_pct:f rain_pct:f calendar_pct:f ramp_amplification_pct:f", f"""
    WITH {_SENS}, d AS (SELECT *, tpart + hpart - rpart AS w, tpart + hpart - rpart + cpart AS dev FROM sx), e AS (SELECT *, dev / base_load * 100 AS pct, abs(w) + abs(cpart) + 0.01::DOUBLE AS tot FROM d)
    SELECT state, scenario_id, dev AS deviation_mw, pct AS deviation_pct, CASE WHEN abs(pct) > 10 THEN 'Critical' WHEN abs(pct) > 6 THEN 'Elevated' WHEN abs(pct) > 3 THEN 'Moderate' ELSE 'Low' END AS stress_class, abs(tpart) / tot * 100 AS temperature_pct,
      abs(hpart) / tot * 100 AS humidity_pct, abs(rpart) / tot * 100 AS rain_pct, abs(cpart) / tot * 100 AS calendar_pct, CASE WHEN td > 0 THEN abs(td * 2 + hd * 0.5::DOUBLE) ELSE 0 END AS ramp_amplification_pct FROM e""")
def _(v):
    return sc.deviation_summary(v.frame_once, scen(v))


@query("n12_stress_index", "state scenario_id weather_score:f calendar_score:f hybrid_score:f stress_index:f banner", f"""
    WITH {_SENS}, bd AS (SELECT state, avg(load) AS sw FROM v_eda1 WHERE bridge_day = 1 GROUP BY state), j AS (SELECT sx.*, sw FROM sx LEFT JOIN bd USING (state)),
    k AS (SELECT *, abs((tpart + hpart - rpart) / base_load * 100) * 1.5::DOUBLE AS ws, abs(coalesce((wk - wd) / wd * 100, 0)) + abs(coalesce(wd - hl, 0) / base_load * 100) AS cs,
      (abs(coalesce((fr - wd) / wd * 100, 0)) + abs(coalesce((mo - wd) / wd * 100, 0)) + abs(coalesce((sw - wd) / wd * 100, 0))) * 2 AS hs FROM j),
    l AS (SELECT *, least(100, ws * 0.4::DOUBLE + cs * 0.3::DOUBLE + hs * 0.3::DOUBLE) AS idx FROM k)
    SELECT state, scenario_id, ws AS weather_score, cs AS calendar_score, hs AS hybrid_score, idx AS stress_index, CASE WHEN idx > 70 THEN 'critical' WHEN idx > 40 THEN 'evaluated peak risk' ELSE 'normal' END AS banner FROM l""")
def _(v):
    bridge = day_context(v.load.select("date").distinct(), v.hol).where("bridge_day = 1")
    return sc.stress_index(v.frame_once, bridge, scen(v))


@query("n13_stress_heatmap", "state dow:i scenario avg_temp:f avg_hum:f n:i stress_index:f risk_level has_peak is_top", f"""
    WITH {_SENS}, g AS (SELECT *, coalesce(CASE WHEN temperature <= -10 THEN NULL WHEN temperature <= 15 THEN 'Cool' WHEN temperature <= 25 THEN 'Mild' WHEN temperature <= 35 THEN 'Hot' WHEN temperature <= 100 THEN 'Extreme' END, 'nan') || '-' ||
        coalesce(CASE WHEN humidity <= -1 THEN NULL WHEN humidity <= 40 THEN 'Dry' WHEN humidity <= 70 THEN 'Normal' WHEN humidity <= 100 THEN 'Humid' END, 'nan') AS scenario FROM v_frame),
    c AS (SELECT state, dow, scenario, avg(temperature) AS avg_temp, avg(humidity) AS avg_hum, max(load) AS ml, count(*) AS n FROM g GROUP BY ALL), m AS (SELECT state, avg(temperature) AS tmn, avg(humidity) AS hmn, quantile_cont(load, 0.95) AS p95 FROM v_frame GROUP BY state),
    x AS (SELECT c.*, p95, least(100, coalesce(abs(((avg_temp - tmn) * tb + (avg_hum - hmn) * hb) / base_load * 100), 0) * 0.7::DOUBLE + (CASE WHEN dow >= 5 THEN 15 ELSE 5 END + CASE WHEN dow IN (0, 4) THEN 10 ELSE 0 END) * 0.3::DOUBLE) AS stress_index FROM c JOIN ss USING (state) JOIN m USING (state))
    SELECT *, CASE WHEN stress_index > 8 THEN 'Red' WHEN stress_index > 5 THEN 'Orange' WHEN stress_index > 2 THEN 'Amber' ELSE 'Green' END AS risk_level, ml > p95 AS has_peak, row_number() OVER (PARTITION BY state ORDER BY round(stress_index, 9) DESC, dow, scenario) = 1 AS is_top FROM x""")
def _(v):
    return sc.stress_heatmap(v.frame_once)


@query("n14_scenario_summary", "scenario_id state peak_mw:f energy_mwh:f net_pct:f", f"""
    WITH s AS (SELECT id, sw::DOUBLE AS sw, st::DOUBLE AS st, lo, hi FROM (VALUES {_SL}) t(id, sw, st, sh, sd, lo, hi)),
    x AS (SELECT id, state, baseline AS b, baseline * (1 + least(greatest(coalesce((temperature - n_temp) * 0.012::DOUBLE * st * sw, 0), -0.4), 0.5) * CASE WHEN block BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END) AS f FROM v_base CROSS JOIN s WHERE date = DATE '2024-01-20')
    SELECT id AS scenario_id, state, max(f) AS peak_mw, sum(f) * 0.25::DOUBLE AS energy_mwh, (sum(f) - sum(b)) / sum(b) * 100 AS net_pct FROM x GROUP BY ALL""")
def _(v):
    s = dims.values_frame(v.spark, "scenario_id, s_weather, s_temperature, s_humidity, s_daytype, b_lo, b_hi", _SL)
    rows = v.base.where(F.col("date") == F.lit("2024-01-20").cast("date")).withColumn("temperature_base", (F.col("temperature") - F.col("n_temp")) * 0.012)
    return sc.scenario_summary(at.driver_matrix(rows, s, ["temperature"]), ["scenario_id", "state"])


@query("n15_full_weather_impact", "state factor slope:f rho:f strongest", f"""
    WITH s AS (SELECT state, {slope('load', 'temperature')} AS t, {slope('load', 'humidity')} AS h, {slope('load', 'precipitation')} AS p FROM v_frame GROUP BY state),
    l AS (SELECT state, 'temperature' AS pair, t AS slope FROM s UNION ALL SELECT state, 'humidity', h FROM s UNION ALL SELECT state, 'precipitation', p FROM s), r AS ({spearman('v_frame', 'state', {c: ('load', c) for c in ('temperature', 'humidity', 'precipitation')})})
    SELECT l.state, pair AS factor, slope, rho, row_number() OVER (PARTITION BY l.state ORDER BY round(abs(rho), 9) DESC, pair) = 1 AS strongest FROM l LEFT JOIN r USING (state, pair)""")
def _(v):
    return sc.full_weather_impact(v.frame)


@query("n16_elasticity_impact", "state date block:i impact_pct:f weather_mw:f momentum_mw:f simulated:f", f"""
    WITH {_IMP}, w AS (SELECT state, block, {slope('load', 'temperature')} / avg(load) AS tw, {slope('load', 'humidity')} / avg(load) AS hw FROM v_frame GROUP BY ALL),
    d AS (SELECT *, temperature - max(temperature) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS dt, humidity - max(humidity) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS dh, max(load) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS y1,
      max(load) OVER (b RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - max(load) OVER (b RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS dod FROM v_t WINDOW b AS (PARTITION BY state, block ORDER BY dn)),
    x AS (SELECT d.*, regime, first_rain_event AS fr, coalesce(dt * tw, 0) + coalesce(dh * hw, 0) AS pct, avg(abs(dod)) OVER (PARTITION BY d.state, d.date) AS dev FROM d LEFT JOIN w USING (state, block) JOIN iy USING (state, date)),
    y AS (SELECT *, least(greatest(pct, CASE WHEN regime = 'hot_dry' THEN -0.18 WHEN regime = 'active_monsoon' AND fr THEN -0.1 WHEN regime = 'active_monsoon' THEN -0.15 ELSE -0.18 END),
      CASE WHEN regime = 'hot_dry' AND block BETWEEN 25 AND 72 THEN 0.18 WHEN regime = 'hot_dry' THEN 0.12 WHEN regime = 'active_monsoon' AND fr THEN 0.08 WHEN regime = 'active_monsoon' THEN 0.1 ELSE 0.12 END) AS impact_pct, CASE WHEN dev > 150 THEN 0.18::DOUBLE ELSE 0.45::DOUBLE END AS lam FROM x)
    SELECT state, date, block, impact_pct, y1 * impact_pct AS weather_mw, lam * coalesce(dod, 0) AS momentum_mw, y1 + y1 * impact_pct + lam * coalesce(dod, 0) AS simulated FROM y""")
def _(v):
    from quarterhour.functions.stats import slope as sl
    w = v.frame.groupBy("state", "block").agg((sl("load", "temperature") / F.avg("load")).alias("temperature_weight"), (sl("load", "humidity") / F.avg("load")).alias("humidity_weight"))
    return at.elasticity_impact(v.frame, w, wx.impact_context(v.frame), ["temperature", "humidity"], momentum=0.45)


@query("n17_clean_yesterday", "state date total:f mean:f std:f anomalous replacement", """
    WITH d AS (SELECT state, date, sum(load) AS total, isodow(date) AS dow, row_number() OVER (PARTITION BY state, isodow(date) ORDER BY date) AS i FROM v_load GROUP BY state, date),
    s AS (SELECT *, count(total) OVER w AS n, avg(total) OVER w AS mean, stddev_pop(total) OVER w AS std FROM d WINDOW w AS (PARTITION BY state, dow ORDER BY date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    b AS (SELECT *, coalesce(n >= 2 AND std > 0 AND abs(total - mean) > 1.2::DOUBLE * std, false) AS anomalous FROM s)
    SELECT b.state, b.date, b.total, b.mean, b.std, anomalous, CASE WHEN anomalous THEN (SELECT max(c.date) FROM d c WHERE c.state = b.state AND c.dow = b.dow AND c.i BETWEEN b.i - 8 AND b.i - 1 AND abs(c.total - b.mean) <= 1.2::DOUBLE * b.std) ELSE b.date END AS replacement FROM b""")
def _(v):
    return at.clean_yesterday(v.load, sigmas=1.2, min_weeks=2)
