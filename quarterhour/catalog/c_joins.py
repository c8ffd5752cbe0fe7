"""2.C joins and set operations."""

from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.catalog.a_sources import _CANON_SQL, _MERGED, place_feed
from quarterhour.catalog.core import query
from quarterhour.operators import calendar, merge
from quarterhour.operators.grid import dense_grid
from quarterhour.operators.scenarios import compare_scenarios
from quarterhour.sources import sinks

SEGMENTS = "('night', 89, 24), ('morning', 25, 44), ('midday', 45, 68), ('evening', 69, 88)"


def segments(v):
    return dims.values_frame(v.spark, "segment, seg_start, seg_end", SEGMENTS)


@query("c1_priority_merge", "state date block:i load:f", f"WITH {_MERGED} SELECT * FROM mg")
def _(v):
    return merge.priority_merge(v.sldc, v.load)


@query("c2_load_left_weather", "state date block:i load:f temperature:f humidity:f", """
    SELECT state, date, block, load, temperature, humidity FROM v_sldc LEFT JOIN v_wmean USING (state, date, block)""")
def _(v):
    return merge.with_weather(v.sldc, v.wmean)


@query("c3_inner_weather_load", "state date block:i load:f temperature:f", """
    SELECT state, date, block, load, temperature FROM v_load JOIN v_wmean USING (state, date, block) WHERE block BETWEEN 69 AND 88""")
def _(v):
    return merge.with_weather(v.load, v.wmean, "inner").where(F.col("block").between(69, 88))


@query("c4_dense_grid", "state date block:i load:f", "SELECT * FROM v_grid")
def _(v):
    return dense_grid(v.load)


@query("c5_semi_join_dates", "state date block:i load:f", """
    SELECT * FROM v_load l WHERE EXISTS (SELECT 1 FROM (SELECT state, date FROM v_load GROUP BY ALL HAVING sum(load) > 5000) d WHERE d.state = l.state AND d.date = l.date)""")
def _(v):
    busy = v.load.groupBy("state", "date").agg(F.sum("load").alias("s")).where("s > 5000").select("state", "date")
    return merge.only_dates(v.load, busy)


_TYPED = """typed AS (
      SELECT state, location, date, block, temperature, CASE WHEN block <= 48 OR date < DATE '2024-01-20' THEN 'HISTORICAL' ELSE 'FORECAST' END AS type FROM v_wloc
      UNION ALL SELECT state, location, date, block, temperature + 1, 'FORECAST' FROM v_wloc WHERE date >= DATE '2024-01-18')"""


def typed(v):
    w = v.wloc.select("state", "location", "date", "block", "temperature")
    hist = (F.col("block") <= 48) | (F.col("date") < F.lit("2024-01-20").cast("date"))
    a = w.withColumn("type", F.when(hist, "HISTORICAL").otherwise("FORECAST"))
    b = w.where(F.col("date") >= F.lit("2024-01-18").cast("date")).withColumn("temperature", F.col("temperature") + 1).withColumn("type", F.lit("FORECAST"))
    return a.unionByName(b)


@query("c6_historical_over_forecast", "state location date block:i temperature:f type", f"""
    WITH {_TYPED} SELECT * FROM typed t WHERE type <> 'FORECAST' OR NOT EXISTS (
      SELECT 1 FROM typed h WHERE h.type = 'HISTORICAL' AND h.state = t.state AND h.location = t.location AND h.date = t.date)""")
def _(v):
    return merge.history_before_forecast(typed(v), ["state", "location", "date"])


@query("c7_keep_preferred", "state location date block:i temperature:f type", f"""
    WITH {_TYPED} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY state, location, date, block ORDER BY type DESC, temperature DESC) AS rn FROM typed) WHERE rn = 1""")
def _(v):
    return merge.keep_preferred(typed(v), ["state", "location", "date", "block"])


@query("c8_fill_from_second_feed", "state date block:i load:f", """
    WITH a AS (SELECT * FROM v_sldc), m AS (SELECT state, date, block, a.load AS la, a.state IS NOT NULL AND a.load IS NOT NULL AS ina, b.load AS lb FROM a FULL OUTER JOIN v_load b USING (state, date, block)),
    x AS (SELECT m.*, last FROM m LEFT JOIN (SELECT state, max(date) AS last FROM a GROUP BY state) USING (state))
    SELECT state, date, block, CASE WHEN coalesce(la, 0) = 0 THEN coalesce(lb, la) ELSE la END AS load FROM x WHERE ina OR last IS NULL OR date > last""")
def _(v):
    return merge.fill_from(v.sldc, v.load)


_SHARES = ", ".join(f"('{ {c: d for d, c in dims.CIRCLE_OF_DISTRICT.items()}.get(c, c) }', '{c}', {w}::DOUBLE)" for c, w in dims.CIRCLE_SHARE_PCT.items())


@query("c9_district_dimension", "state date block:i district circle share_pct:f temperature_2m:f", f"""
    SELECT w.state, w.date, w.block, w.district, s.circle, coalesce(s.share_pct, 0) AS share_pct, temperature AS temperature_2m
    FROM (SELECT *, {_CANON_SQL} AS district FROM v_wloc) w LEFT JOIN (VALUES {_SHARES}) s(district, circle, share_pct) USING (district)""")
def _(v):
    return merge.map_districts(place_feed(v), dims.canonical_weights(v.spark), "city").withColumnRenamed("time_block", "block")


@query("c10_holiday_distance", "date days_to_holiday:i days_since_holiday:i", """
    SELECT d.date, least(coalesce(min(h.holiday - d.date) FILTER (WHERE h.holiday >= d.date), 7), 7) AS days_to_holiday,
      least(coalesce(min(d.date - h.holiday) FILTER (WHERE h.holiday <= d.date), 7), 7) AS days_since_holiday
    FROM (SELECT DISTINCT date FROM v_daily) d CROSS JOIN v_hol h GROUP BY d.date""")
def _(v):
    return calendar.holiday_distance(v.daily.select("date").distinct(), v.hol, cap=7)


@query("c11_day_lags", "state date block:i load:f lag_1d:f lag_2d:f lag_7d:f lag_14d:f", """
    SELECT l.state, l.date, l.block, l.load, a.load AS lag_1d, b.load AS lag_2d, c.load AS lag_7d, d.load AS lag_14d FROM v_load l
    LEFT JOIN v_load a ON a.state = l.state AND a.block = l.block AND a.date = l.date - 1 LEFT JOIN v_load b ON b.state = l.state AND b.block = l.block AND b.date = l.date - 2
    LEFT JOIN v_load c ON c.state = l.state AND c.block = l.block AND c.date = l.date - 7 LEFT JOIN v_load d ON d.state = l.state AND d.block = l.block AND d.date = l.date - 14""")
def _(v):
    return merge.with_day_lags(v.load, (1, 2, 7, 14))


@query("c11_year_lag_daily", "state date load:f lag_365d:f", """
    SELECT l.state, l.date, l.load, b.load AS lag_365d FROM v_daily l LEFT JOIN v_daily b ON b.state = l.state AND b.date = l.date - 365""")
def _(v):
    from quarterhour.operators.grid import day_lag
    return v.daily.withColumn("lag_365d", day_lag("load", 365, ("state",)))


_SCEN = """sc AS (SELECT CASE WHEN date = DATE '2024-01-10' THEN 'base' ELSE 'target' END AS scenario_id, state, block, load AS final_mw FROM v_load WHERE date IN (DATE '2024-01-10', DATE '2024-01-17'))"""


def two_scenarios(v):
    days = v.load.where(F.col("date").isin(F.lit("2024-01-10").cast("date"), F.lit("2024-01-17").cast("date")))
    sid = F.when(F.col("date") == F.lit("2024-01-10").cast("date"), "base").otherwise("target")
    return days.select(sid.alias("scenario_id"), "state", "block", F.col("load").alias("final_mw"))


@query("c12_scenario_compare", "state peak_change:f energy_change:f max_block_delta:f blocks:i", f"""
    WITH {_SCEN}, p AS (SELECT b.state, b.block, b.final_mw AS bm, coalesce(t.final_mw, b.final_mw) AS tm FROM sc b LEFT JOIN sc t
      ON t.scenario_id = 'target' AND t.state = b.state AND t.block = b.block WHERE b.scenario_id = 'base')
    SELECT state, max(tm) - max(bm) AS peak_change, (sum(tm) - sum(bm)) * 0.25::DOUBLE AS energy_change, max(abs(tm - bm)) AS max_block_delta, count(*) AS blocks FROM p GROUP BY state""")
def _(v):
    return compare_scenarios(two_scenarios(v), "base", "target")


@query("c13_insert_without_conflict", "state date block:i model forecast:f", """
    SELECT * FROM v_fcm n WHERE model = 'lag1' AND NOT EXISTS (SELECT 1 FROM v_fcm s WHERE s.model = 'lag7' AND s.state = n.state AND s.date = n.date AND s.block = n.block)""")
def _(v):
    new, old = v.fcm.where("model = 'lag1'"), v.fcm.where("model = 'lag7'")
    return sinks.not_stored(new, old, ["state", "date", "block"])


@query("c14_union_unlike", "state date block:i load:f forecast:f", """
    SELECT state, date, block, load, NULL::DOUBLE AS forecast FROM v_load UNION ALL SELECT state, date, block, NULL, forecast FROM v_fc""")
def _(v):
    return merge.append_unlike(v.load, v.fc)


@query("c15_set_operations", "op item", """
    SELECT 'union' AS op, CAST(date AS VARCHAR) AS item FROM (SELECT date FROM v_sldc WHERE state = 'R0' UNION SELECT date FROM v_load WHERE state = 'R1')
    UNION ALL SELECT 'intersect', location FROM (SELECT location FROM v_wloc WHERE state = 'R0' AND block = 3 INTERSECT SELECT location FROM v_wloc WHERE state = 'R1' AND block = 90)
    UNION ALL SELECT 'except', CAST(date AS VARCHAR) FROM (SELECT date FROM v_load EXCEPT SELECT date FROM v_load WHERE load > 800)""")
def _(v):
    u = v.sldc.where("state = 'R0'").select("date").union(v.load.where("state = 'R1'").select("date")).distinct().select(F.lit("union").alias("op"), F.col("date").cast("string").alias("item"))
    i = v.wloc.where("state = 'R0' and block = 3").select("location").intersect(v.wloc.where("state = 'R1' and block = 90").select("location")).select(F.lit("intersect").alias("op"), F.col("location").alias("item"))
    e = v.load.select("date").subtract(v.load.where("load > 800").select("date")).select(F.lit("except").alias("op"), F.col("date").cast("string").alias("item"))
    return u.unionByName(i).unionByName(e)


@query("c16_benchmarks", "state date block:i today:f t_minus_1d:f t_minus_7d:f t_minus_365d:f", """
    WITH c AS (SELECT state, date, block, CASE WHEN load > 1 THEN load END AS load FROM v_grid)
    SELECT c.state, c.date, c.block, c.load AS today, a.load AS t_minus_1d, b.load AS t_minus_7d, y.load AS t_minus_365d FROM c
    LEFT JOIN c a ON a.state = c.state AND a.block = c.block AND a.date = c.date - 1 LEFT JOIN c b ON b.state = c.state AND b.block = c.block AND b.date = c.date - 7
    LEFT JOIN c y ON y.state = c.state AND y.block = c.block AND y.date = c.date - 365""")
def _(v):
    return merge.benchmarks(v.grid)


_DATES = ["2024-01-12", "2024-01-13", "2024-01-20"]


@query("c17_date_overlay", "state block:i d_2024_01_12:f d_2024_01_13:f d_2024_01_20:f", """
    SELECT state, block, max(load) FILTER (WHERE date = DATE '2024-01-12') AS d_2024_01_12, max(load) FILTER (WHERE date = DATE '2024-01-13') AS d_2024_01_13,
      max(load) FILTER (WHERE date = DATE '2024-01-20') AS d_2024_01_20 FROM v_load WHERE date IN (DATE '2024-01-12', DATE '2024-01-13', DATE '2024-01-20') GROUP BY state, block""")
def _(v):
    return merge.pivot_dates(v.load, _DATES)


@query("c17_date_stats", "state date avg:f max:f min:f", """
    SELECT state, date, avg(load) AS avg, max(load) AS max, min(load) AS min FROM v_load WHERE date IN (DATE '2024-01-12', DATE '2024-01-13', DATE '2024-01-20') GROUP BY ALL""")
def _(v):
    from quarterhour.operators.kpis import daily
    return daily(v.load.where(F.col("date").isin(*[F.lit(d).cast("date") for d in _DATES])))


@query("c18_segment_range_join", "state date segment load:f n:i", f"""
    SELECT l.state, l.date, segment, sum(load) AS load, count(*) AS n FROM v_load l JOIN (VALUES {SEGMENTS}) s(segment, a, b)
      ON CASE WHEN a > b THEN block >= a OR block <= b ELSE block BETWEEN a AND b END GROUP BY ALL""")
def _(v):
    j = merge.segment_join(v.load, segments(v))
    return j.groupBy("state", "date", "segment").agg(F.sum("load").alias("load"), F.count(F.lit(1)).alias("n"))
