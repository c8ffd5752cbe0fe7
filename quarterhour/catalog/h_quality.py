"""2.H data quality and gates."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.operators import quality as q
from quarterhour.operators.grid import day_lag

_LOADQ = """cell AS (SELECT state, date, block, count(*) AS n, avg(value) AS v FROM v_ev WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-02-02' GROUP BY ALL),
    dd AS (SELECT state, date, count(v) AS present, sum(n - 1) AS dup, count(*) FILTER (WHERE v <= 3) AS nonpos FROM cell GROUP BY state, date),
    cal AS (SELECT state, CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT state FROM v_load)),
    j AS (SELECT cal.state, cal.date, coalesce(present, 0) AS present, dup, nonpos FROM cal LEFT JOIN dd USING (state, date)),
    s AS (SELECT state, count(*) * 96 AS expected_blocks, sum(present) AS present_blocks, coalesce(sum(dup), 0) AS duplicate_blocks, coalesce(sum(nonpos), 0) AS nonpositive_blocks, count(*) FILTER (WHERE present = 0) AS missing_dates,
      count(*) FILTER (WHERE present BETWEEN 1 AND 95) AS partial_dates, coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE present = 0), '') AS missing_list FROM j GROUP BY state),
    lc AS (SELECT *, present_blocks * 1.0::DOUBLE / expected_blocks AS share, CASE WHEN present_blocks * 1.0::DOUBLE / expected_blocks < 0.5 THEN 'failed'
      WHEN present_blocks * 1.0::DOUBLE / expected_blocks < 0.99 OR missing_dates > 0 OR nonpositive_blocks > 0 THEN 'degraded' ELSE 'ok' END AS status FROM s)"""


def contract(v):
    rows = v.ev.select("state", "date", "block", (F.col("value") - 3).alias("load"))
    return q.load_contract(rows, "2024-01-05", "2024-02-02", rows.select("state").distinct())


@query("h1_load_contract", "state expected_blocks:i present_blocks:i duplicate_blocks:i nonpositive_blocks:i missing_dates:i partial_dates:i missing_list share:f status", f"WITH {_LOADQ} SELECT * FROM lc")
def _(v):
    return contract(v)


@query("h1_range_check", "state out_of_range:i max_value:f min_value:f out_of_range_pct:f", """
    SELECT state, count(*) FILTER (WHERE load NOT BETWEEN 5 AND 500) AS out_of_range, max(load) AS max_value, min(load) AS min_value, count(*) FILTER (WHERE load NOT BETWEEN 5 AND 500) * 100.0::DOUBLE / count(load) AS out_of_range_pct FROM v_load GROUP BY state""")
def _(v):
    return q.range_check(v.load, "load", 5.0, 500.0)


_WQ = """wc AS (SELECT s.state, count(*) AS districts_expected, count(n) AS districts_seen, coalesce(sum(n), 0) * 100.0::DOUBLE / (count(*) * 10 * 96) AS coverage_pct, coalesce(string_agg(e.location, ',' ORDER BY e.location) FILTER (WHERE n IS NULL), '') AS missing_districts
      FROM (SELECT DISTINCT state FROM v_wloc) s CROSS JOIN (SELECT location FROM v_dw UNION SELECT 'D9') e
      LEFT JOIN (SELECT state, location, count(DISTINCT (date, block)) AS n FROM v_wloc WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-19' AND temperature IS NOT NULL GROUP BY ALL) c USING (state, location) GROUP BY s.state)"""


def weather_contract(v):
    expected = v.dw.select("location").unionByName(v.spark.sql("SELECT 'D9' AS location"))
    return q.weather_contract(v.wloc, expected, "2024-01-10", "2024-01-19")


@query("h2_weather_contract", "state districts_expected:i districts_seen:i coverage_pct:f missing_districts status", f"""
    WITH {_WQ} SELECT *, CASE WHEN districts_seen = 0 OR coverage_pct < 90 THEN 'degraded' ELSE 'ok' END AS status FROM wc""")
def _(v):
    return weather_contract(v)


@query("h3_quality_report", "state expected_blocks:i present_blocks:i missing_dates:i load_status coverage_pct:f weather_status status", f"""
    WITH {_LOADQ}, {_WQ}, rp AS (SELECT lc.*, wc.coverage_pct, CASE WHEN districts_seen = 0 OR coverage_pct < 90 THEN 'degraded' ELSE 'ok' END AS weather_status FROM lc LEFT JOIN wc USING (state))
    SELECT state, expected_blocks, present_blocks, missing_dates, status AS load_status, coverage_pct, weather_status,
      CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'degraded' OR weather_status = 'degraded' THEN 'degraded' ELSE 'ok' END AS status FROM rp""")
def _(v):
    return q.quality_report(contract(v), weather_contract(v))


_BANDED = """fd AS (SELECT g.state, g.date, g.block, g.load, max(g.load) OVER (PARTITION BY state, block ORDER BY g.date - DATE '1970-01-01' RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS p FROM v_grid g),
    fb AS (SELECT state, date, block, load, p * 0.95::DOUBLE AS p10, p AS p50, CASE WHEN block % 40 = 0 THEN p * 0.9::DOUBLE ELSE p * 1.05::DOUBLE END AS p90 FROM fd)"""


def banded(v):
    g = v.grid.withColumn("p", day_lag("load", 7))
    return g.select("state", "date", "block", "load", (F.col("p") * 0.95).alias("p10"), F.col("p").alias("p50"), F.when(F.col("block") % 40 == 0, F.col("p") * 0.9).otherwise(F.col("p") * 1.05).alias("p90"))


@query("h4_forecast_gate", "state date blocks:i missing:i crossings:i negatives:i big_ramps:i max_ramp:f status", f"""
    WITH {_BANDED}, r AS (SELECT *, abs(p50 - lag(p50) OVER (PARTITION BY state, date ORDER BY block)) AS r FROM fb),
    g AS (SELECT state, date, count(*) AS blocks, count(*) FILTER (WHERE p10 IS NULL OR p50 IS NULL OR p90 IS NULL) AS missing, count(*) FILTER (WHERE p10 > p50 OR p50 > p90) AS crossings, count(*) FILTER (WHERE p10 < 0 OR p50 < 0 OR p90 < 0) AS negatives,
      count(*) FILTER (WHERE r > 300) AS big_ramps, max(r) AS max_ramp FROM r GROUP BY state, date)
    SELECT *, CASE WHEN blocks <> 96 OR missing > 0 OR crossings > 0 OR negatives > 0 THEN 'failed' ELSE 'ok' END AS status FROM g""")
def _(v):
    return q.forecast_gate(banded(v), ramp_mw=300.0)


@query("h5_schedule_validator", "state date floor_breaches:i ceiling_breaches:i ramp_breaches:i large_deviations:i schedule_mwh:f baseline_mwh:f energy_gap_pct:f flags status", """
    WITH x AS (SELECT *, least(greatest(forecast, 45), 400) AS adj, forecast < 45 AS lo, greatest(forecast, 45) > 400 AS hi FROM v_pair),
    r AS (SELECT *, abs(adj - lag(adj) OVER (PARTITION BY state, date ORDER BY block)) AS r FROM x),
    g AS (SELECT state, date, count(*) FILTER (WHERE lo) AS floor_breaches, count(*) FILTER (WHERE hi) AS ceiling_breaches, count(*) FILTER (WHERE r > 250) AS ramp_breaches,
      count(*) FILTER (WHERE abs(adj - actual) / greatest(abs(actual), 1) * 100 > 15) AS large_deviations, sum(adj) * 0.25::DOUBLE AS schedule_mwh, sum(actual) * 0.25::DOUBLE AS baseline_mwh FROM r GROUP BY state, date),
    e AS (SELECT *, abs(schedule_mwh - baseline_mwh) / greatest(abs(baseline_mwh), 1) * 100 AS energy_gap_pct FROM g),
    f AS (SELECT *, concat_ws(';', CASE WHEN floor_breaches > 0 THEN 'FLOOR_BREACH' END, CASE WHEN ceiling_breaches > 0 THEN 'CEILING_BREACH' END, CASE WHEN ramp_breaches > 0 THEN 'RAMP_BREACH' END,
      CASE WHEN large_deviations > 0 THEN 'LARGE_DEVIATION' END, CASE WHEN energy_gap_pct > 5 THEN 'ENERGY_GAP' END) AS flags FROM e)
    SELECT *, CASE WHEN flags = '' THEN 'ok' ELSE 'flagged' END AS status FROM f""")
def _(v):
    return q.validate_schedule(v.pair, "forecast", "actual", floor=50.0, cap=400.0, max_ramp=250.0, winter=F.month("date").isin(12, 1, 2))


@query("h6_forecast_quality", "state date gate_status load_status missing_load_blocks:i coverage_pct:f load_share_coverage_pct:f history_days:i status short_history", f"""
    WITH {_BANDED}, {_LOADQ}, {_WQ},
    g AS (SELECT state, date, CASE WHEN count(*) <> 96 OR count(*) FILTER (WHERE p10 IS NULL OR p50 IS NULL OR p90 IS NULL) > 0 OR count(*) FILTER (WHERE p10 > p50 OR p50 > p90) > 0 THEN 'failed' ELSE 'ok' END AS gate_status FROM fb GROUP BY state, date),
    cv AS (SELECT state, date, avg(w) AS load_share_coverage_pct FROM (SELECT state, date, block, sum(weight) FILTER (WHERE temperature IS NOT NULL) / 28 * 100 AS w FROM v_wloc JOIN v_dw USING (location) GROUP BY ALL) GROUP BY ALL),
    h AS (SELECT state, count(DISTINCT date) AS history_days FROM v_load GROUP BY state),
    x AS (SELECT g.*, lc.status AS load_status, expected_blocks - present_blocks AS missing_load_blocks, coverage_pct, CASE WHEN districts_seen = 0 OR coverage_pct < 90 THEN 'degraded' ELSE 'ok' END AS ws, load_share_coverage_pct, history_days
      FROM g JOIN lc USING (state) LEFT JOIN wc USING (state) LEFT JOIN cv USING (state, date) LEFT JOIN h USING (state))
    SELECT *, CASE WHEN 'failed' IN (gate_status, load_status, ws) THEN 'failed' WHEN 'degraded' IN (gate_status, load_status, ws) THEN 'degraded' ELSE 'ok' END AS status, history_days < 365 AS short_history FROM x""")
def _(v):
    w = v.wloc.join(v.dw, "location").groupBy("state", "date", "block").agg((F.sum(F.when(F.col("temperature").isNotNull(), F.col("weight"))) / 28.0 * 100).alias("w"))
    cov = w.groupBy("state", "date").agg(F.avg("w").alias("load_share_coverage_pct"))
    hist = v.load.groupBy("state").agg(F.count_distinct("date").alias("history_days"))
    return q.forecast_quality(contract(v), weather_contract(v), q.forecast_gate(banded(v)), cov, hist)
