"""2.G cleaning and imputation."""

from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import interp
from quarterhour.operators import clean, decompose
from quarterhour.operators.grid import interpolate
from quarterhour.sources import normalise

SPIKE = 250.0


@query("g1_continuity_spikes", "state date block:i load:f was_spike", f"""
    WITH n AS (SELECT *, abs(load - lag(load) OVER w) AS l, abs(lead(load) OVER w - load) AS r, row_number() OVER w AS pos,
        lag(1) OVER w IS NULL AS f, lead(1) OVER w IS NULL AS z FROM v_load WINDOW w AS (PARTITION BY state, date ORDER BY block)),
    s AS (SELECT *, coalesce(CASE WHEN f AND z THEN false WHEN f THEN r > {SPIKE} WHEN z THEN l > {SPIKE} ELSE (l + r) / 2 > {SPIKE} END, false) AS was_spike FROM n),
    x AS (SELECT *, CASE WHEN NOT was_spike THEN load END AS v FROM s)
    SELECT state, date, block, was_spike, filled AS load FROM ({interp('x', 'state, date', 'pos', 'v')})""")
def _(v):
    return clean.fix_spikes(v.load, threshold=SPIKE)


@query("g1_strict_spikes", "state n:i", f"""
    WITH n AS (SELECT *, abs(load - lag(load) OVER w) AS l, abs(lead(load) OVER w - load) AS r, lag(1) OVER w IS NULL AS f, lead(1) OVER w IS NULL AS z
      FROM v_load WINDOW w AS (PARTITION BY state, date ORDER BY block))
    SELECT state, count(*) FILTER (WHERE coalesce(CASE WHEN f AND z THEN false WHEN f THEN r > 100 WHEN z THEN l > 100 ELSE l > 100 AND r > 100 END, false)) AS n FROM n GROUP BY state""")
def _(v):
    f = v.load.withColumn("s", clean.spike_flags(v.load, "load", 100.0, strict=True))
    return f.groupBy("state").agg(F.count(F.when(F.col("s"), 1)).alias("n"))


def zeroed(v):
    return v.load.withColumn("load", F.when(F.col("block") % 7 == 0, 0.0).otherwise(F.col("load")))


@query("g2_zeros_until", "state date block:i load:f was_zero", f"""
    WITH z AS (SELECT state, date, block, CASE WHEN block % 7 = 0 THEN 0 ELSE load END AS load FROM v_load),
    e AS (SELECT *, (date < DATE '2024-01-20' OR (date = DATE '2024-01-20' AND block <= 50)) AND load = 0 AS was_zero,
        row_number() OVER (PARTITION BY state, date ORDER BY block) AS pos FROM z),
    x AS (SELECT *, CASE WHEN NOT was_zero THEN load END AS v FROM e)
    SELECT state, date, block, was_zero, coalesce(filled, load) AS load FROM ({interp('x', 'state, date', 'pos', 'v')})""")
def _(v):
    return clean.fill_zeros_until(zeroed(v), "2024-01-20", 50)


@query("g3_short_drops", "state date block:i load:f was_drop", f"""
    WITH m AS (SELECT *, median(load) OVER (PARTITION BY state, date ORDER BY block ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS med,
        row_number() OVER (PARTITION BY state, date ORDER BY block) AS pos FROM v_load),
    c AS (SELECT *, med - load > 60 AND load < 0.8::DOUBLE * med AS cand FROM m),
    g AS (SELECT *, sum(CASE WHEN cand = pc THEN 0 ELSE 1 END) OVER (PARTITION BY state, date ORDER BY block) AS run FROM
        (SELECT *, lag(cand) OVER (PARTITION BY state, date ORDER BY block) AS pc FROM c)),
    r AS (SELECT *, cand AND count(*) OVER (PARTITION BY state, date, run) <= 4 AS was_drop FROM g),
    x AS (SELECT *, CASE WHEN NOT was_drop THEN load END AS v FROM r)
    SELECT state, date, block, was_drop, filled AS load FROM ({interp('x', 'state, date', 'pos', 'v')})""")
def _(v):
    return clean.smooth_drops(v.load, delta=60.0, factor=0.8)


@query("g4_linear_interpolation", "state date block:i load:f", f"""
    WITH x AS (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) * 96 + block AS t FROM v_grid)
    SELECT state, date, block, filled AS load FROM ({interp('x', 'state', 't', 'load')})""")
def _(v):
    return clean.fill_grid(v.load)


@query("g4_within_day", "state date block:i load:f", f"SELECT state, date, block, filled AS load FROM ({interp('v_grid', 'state, date', 'block', 'load')})")
def _(v):
    return interpolate(v.grid, "load", ["state", "date"], "block")


@query("g5_quarter_rain", "state location date block:i precipitation:f", """
    WITH h AS (SELECT state, location, date_trunc('hour', CAST(date AS TIMESTAMP) + to_minutes((block - 1) * 15)) AS ts, avg(precipitation) AS p FROM v_wloc GROUP BY ALL),
    q AS (SELECT state, location, ts - to_minutes(m) AS ts, p FROM h CROSS JOIN (VALUES (0), (15), (30), (45)) t(m))
    SELECT state, location, CAST(ts AS DATE) AS date, hour(ts) * 4 + minute(ts) // 15 + 1 AS block, sum(p) / 4 AS precipitation FROM q GROUP BY state, location, ts""")
def _(v):
    from quarterhour.functions.blocks import block_start
    return clean.quarter_rain(v.wloc.withColumn("ts", block_start("date", "block")))


_HOURLY = """h AS (SELECT state, location, date, CAST((block - 1) // 4 * 4 + 1 AS INTEGER) AS block, avg(temperature) AS temperature FROM v_wloc GROUP BY ALL),
    g AS (SELECT x.state, x.location, x.date, x.block, h.temperature, CAST(x.date - DATE '1970-01-01' AS BIGINT) * 96 + x.block AS t FROM (
      SELECT state, location, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date, b.block
      FROM h CROSS JOIN (SELECT CAST(unnest(range(1, 97)) AS INTEGER) AS block) b GROUP BY state, location, b.block) x LEFT JOIN h USING (state, location, date, block))"""


@query("g6_hourly_weather_to_blocks", "state location date block:i temperature:f", f"""
    WITH {_HOURLY} SELECT state, location, date, block, filled AS temperature FROM ({interp('g', 'state, location', 't', 'temperature')})""")
def _(v):
    hourly = v.wloc.groupBy("state", "location", "date", (F.floor((F.col("block") - 1) / 4).cast("int") * 4 + 1).alias("block")).agg(F.avg("temperature").alias("temperature"))
    return clean.hourly_to_blocks(hourly, ("temperature",))


@query("g7_full_day", "state date block:i load:f temperature:f", f"""
    WITH g AS (SELECT d.state, d.date, b.block, f.load, f.temperature FROM (SELECT DISTINCT state, date FROM v_frame) d
      CROSS JOIN (SELECT CAST(unnest(range(1, 97)) AS INTEGER) AS block) b LEFT JOIN v_frame f USING (state, date, block))
    SELECT state, date, block, load, filled AS temperature FROM ({interp('g', 'state, date', 'block', 'temperature')})""")
def _(v):
    return clean.full_day(v.frame, weather=("temperature",))


_PATCH = "('ALL', DATE '2024-01-09', DATE '2024-01-10', 83, 96), ('ALL', DATE '2024-01-10', DATE '2024-01-11', 1, 31), ('R2', DATE '2024-01-02', DATE '2024-01-05', 10, 20)"


@query("g8_patch_blocks", "state date block:i load:f patched", f"""
    WITH p AS (SELECT * FROM (VALUES {_PATCH}) t(state, from_date, to_date, b_lo, b_hi)),
    c AS (SELECT p.state, p.to_date AS date, l.block, l.load AS pl FROM p JOIN v_load l ON l.state = p.state AND l.date = p.from_date AND l.block BETWEEN b_lo AND b_hi)
    SELECT l.state, l.date, l.block, coalesce(c.pl, l.load) AS load, c.pl IS NOT NULL AS patched FROM v_load l LEFT JOIN c USING (state, date, block)""")
def _(v):
    return clean.patch(v.load, dims.values_frame(v.spark, "state, from_date, to_date, b_lo, b_hi", _PATCH))


@query("g9_rain_total", "state location date block:i precipitation:f", """
    SELECT state, location, date, block, coalesce(precipitation, 0) + coalesce(CASE WHEN block % 3 = 0 THEN cloud_cover END, 0) / 10 + 0.5::DOUBLE AS precipitation FROM v_wloc""")
def _(v):
    split = v.wloc.select("state", "location", "date", "block", F.col("precipitation").alias("rain"),
                          F.when(F.col("block") % 3 == 0, F.col("cloud_cover") / 10).alias("showers"), F.lit(0.5).alias("snowfall"))
    return normalise.rain_total(split)


@query("g10_day_vector", "state date blocks:i energy:f first:f last:f", f"""
    SELECT state, date, count(*) AS blocks, sum(filled) * 0.25::DOUBLE AS energy, max(filled) FILTER (WHERE block = 1) AS first, max(filled) FILTER (WHERE block = 96) AS last
    FROM ({interp('v_grid', 'state, date', 'block', 'load')}) GROUP BY state, date HAVING count(load) > 0""")
def _(v):
    d = clean.vector_of_day(v.load)
    return d.select("state", "date", F.size("vec").alias("blocks"), (F.aggregate("vec", F.lit(0.0), lambda a, x: a + x) * 0.25).alias("energy"),
                    F.element_at("vec", 1).alias("first"), F.element_at("vec", -1).alias("last"))


@query("g3_median3_smoother", "state date block:i load:f", """
    SELECT state, date, block, list_sort([coalesce(lag(load) OVER w, load), load, coalesce(lead(load) OVER w, load)])[2] AS load FROM v_load
    WINDOW w AS (PARTITION BY state, date ORDER BY block)""")
def _(v):
    return v.load.withColumn("load", decompose.median3("load", ["state", "date"]))
