"""2.E window functions, rolling statistics and runs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import interp, slope
from quarterhour.operators import decompose
from quarterhour.operators.grid import blocks_back, core_rows, days_ago, rolling, run_ids, run_length_so_far, sliced
from quarterhour.operators.weather import degree_hours


@query("e1_rolling_with_min_periods", "state date block:i mean_24:f std_24:f sum_24:f", """
    SELECT state, date, block, CASE WHEN count(load) OVER w >= 12 THEN avg(load) OVER w END AS mean_24, CASE WHEN count(load) OVER w >= 12 THEN stddev_samp(load) OVER w END AS std_24,
      CASE WHEN count(load) OVER w >= 12 THEN sum(load) OVER w END AS sum_24 FROM v_t WINDOW w AS (PARTITION BY state ORDER BY t RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def _(v):
    s = sliced(v.load, back=23)
    n = rolling(F.count("load"), 24)
    return core_rows(s.withColumns({"mean_24": F.when(n >= 12, rolling(F.avg("load"), 24)), "std_24": F.when(n >= 12, rolling(F.stddev_samp("load"), 24)),
                                    "sum_24": F.when(n >= 12, rolling(F.sum("load"), 24))}))


@query("e2_causal_rolling_per_block", "state date block:i mean_7:f std_14:f n_7:i", """
    SELECT state, date, block, avg(load) OVER (w RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7, stddev_samp(load) OVER (w RANGE BETWEEN 14 PRECEDING AND 1 PRECEDING) AS std_14,
      count(load) OVER (w RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n_7 FROM v_t WINDOW w AS (PARTITION BY state, block ORDER BY dn)""")
def _(v):
    k = ("state", "block")
    return v.load.select("state", "date", "block", F.avg("load").over(days_ago(k, 7, 1)).alias("mean_7"), F.stddev_samp("load").over(days_ago(k, 14, 1)).alias("std_14"),
                         F.count("load").over(days_ago(k, 7, 1)).alias("n_7"))


@query("e3_centred_rolling", "state date block:i centred_mean:f centred_median:f", """
    SELECT state, date, block, avg(load) OVER w AS centred_mean, median(load) OVER w AS centred_median FROM v_load
    WINDOW w AS (PARTITION BY state, date ORDER BY block ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)""")
def _(v):
    from quarterhour.functions.stats import windowed_median
    w = Window.partitionBy("state", "date").orderBy("block").rowsBetween(-6, 6)
    return v.load.select("state", "date", "block", F.avg("load").over(w).alias("centred_mean"), windowed_median("load", w).alias("centred_median"))


@query("e4_rolling_bands", "state date hour:i x:f mean:f std:f upper:f lower:f deviation:f", f"""
    WITH h AS (SELECT state, date, hour, avg(load) AS x, CAST(date - DATE '1970-01-01' AS BIGINT) * 24 + hour AS hn FROM v_cal GROUP BY ALL),
    g AS (SELECT s.state, s.hn, h.x FROM (SELECT state, unnest(generate_series(min(hn), max(hn))) AS hn FROM h GROUP BY state) s LEFT JOIN h USING (state, hn)),
    f AS (SELECT state, hn, filled AS x FROM ({interp('g', 'state', 'hn', 'x')})),
    r AS (SELECT *, CASE WHEN count(x) OVER w >= 168 THEN avg(x) OVER w END AS mean, CASE WHEN count(x) OVER w >= 168 THEN stddev_samp(x) OVER w END AS std FROM f
      WINDOW w AS (PARTITION BY state ORDER BY hn ROWS BETWEEN 167 PRECEDING AND CURRENT ROW))
    SELECT state, CAST(DATE '1970-01-01' + CAST(hn // 24 AS INTEGER) AS DATE) AS date, hn % 24 AS hour, x, mean, std, mean + 2 * std AS upper, mean - 2 * std AS lower, x - mean AS deviation FROM r""")
def _(v):
    return decompose.hourly_bands(v.cal)


@query("e5_daily_decomposition", "state date value:f trend:f detrended:f seasonal:f residual:f", """
    WITH d AS (SELECT state, date, avg(load) AS value, isodow(date) AS dow FROM v_load GROUP BY state, date),
    t AS (SELECT *, CASE WHEN count(value) OVER w >= 7 THEN avg(value) OVER w END AS trend FROM d WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
    x AS (SELECT *, value - trend AS detrended FROM t), s AS (SELECT *, avg(detrended) OVER (PARTITION BY state, dow) AS seasonal FROM x)
    SELECT *, detrended - seasonal AS residual FROM s""")
def _(v):
    return decompose.daily_seasonal(v.load)


_LAYERS = f"""s AS (SELECT *, avg(load) OVER (PARTITION BY state, dow, block) AS seasonal FROM v_frame), y AS (SELECT *, load - seasonal AS y FROM s),
    c AS (SELECT state, {slope('y', 'temperature')} AS b, avg(y) FILTER (WHERE temperature IS NOT NULL) - {slope('y', 'temperature')} * avg(temperature) FILTER (WHERE y IS NOT NULL) AS a,
      avg(temperature) AS tm, count(temperature) AS n FROM y GROUP BY state),
    l AS (SELECT y.*, CASE WHEN n > 20 THEN coalesce(a + b * coalesce(temperature, tm), 0) ELSE 0 END AS weather FROM y JOIN c USING (state)),
    lr AS (SELECT *, y - weather AS residual FROM l)"""


@query("e6_layer_decomposition", "state date block:i seasonal:f weather:f residual:f", f"WITH {_LAYERS} SELECT * FROM lr")
def _(v):
    return decompose.layers(v.frame)


@query("e6_layer_contribution", "state seasonal_pct:f weather_pct:f residual_pct:f", f"""
    WITH {_LAYERS}, t AS (SELECT state, sum(abs(seasonal)) AS s, sum(abs(weather)) AS w, sum(abs(residual)) AS r FROM lr GROUP BY state)
    SELECT state, s / (s + w + r) * 100 AS seasonal_pct, w / (s + w + r) * 100 AS weather_pct, r / (s + w + r) * 100 AS residual_pct FROM t""")
def _(v):
    return decompose.contribution(v.frame)


@query("e7_group_broadcasts", "state date block:i block_mean:f dow_mean:f block_std:f", """
    SELECT state, date, block, avg(load) OVER (PARTITION BY state, block) AS block_mean, avg(load) OVER (PARTITION BY state, dow) AS dow_mean, stddev_samp(load) OVER (PARTITION BY state, block) AS block_std FROM v_cal""")
def _(v):
    from quarterhour.operators.features import join_stats
    d = join_stats(v.cal, ["state", "block"], block_mean=F.avg("load"), block_std=F.stddev_samp("load"))
    return join_stats(d, ["state", "dow"], dow_mean=F.avg("load"))


@query("e8_lags_and_changes", "state date block:i prev:f back_4:f change:f pct_change:f", """
    SELECT state, date, block, max(load) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev, max(load) OVER (w RANGE BETWEEN 4 PRECEDING AND 4 PRECEDING) AS back_4,
      load - max(load) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS change,
      (load / nullif(max(load) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) - 1) * 100 AS pct_change FROM v_t WINDOW w AS (PARTITION BY state ORDER BY t)""")
def _(v):
    from quarterhour.functions.numbers import pct_change
    d = core_rows(sliced(v.load, back=4).withColumns({"prev": blocks_back("load", 1), "back_4": blocks_back("load", 4)}))
    return d.withColumn("change", F.col("load") - F.col("prev")).withColumn("pct_change", pct_change("load", "prev"))


@query("e9_first_and_extremes", "state date first_load:f peak_block:i valley_block:i", """
    SELECT state, date, arg_min(load, block) AS first_load, arg_max(block, (load, -block)) AS peak_block, arg_min(block, (load, block)) AS valley_block FROM v_load GROUP BY state, date""")
def _(v):
    from quarterhour.functions.stats import bottom_by, top_by
    return v.load.groupBy("state", "date").agg(F.min_by("load", "block").alias("first_load"), top_by("block", "load", "block").alias("peak_block"), bottom_by("block", "load", "block").alias("valley_block"))


@query("e10_run_lengths", "state date run_length:i", """
    WITH d AS (SELECT state, date, sum(load) AS s FROM v_load GROUP BY state, date), f AS (SELECT *, s > avg(s) OVER (PARTITION BY state) AS hot FROM d),
    g AS (SELECT *, sum(CASE WHEN hot THEN 0 ELSE 1 END) OVER (PARTITION BY state ORDER BY date) AS grp FROM f)
    SELECT state, date, sum(CASE WHEN hot THEN 1 ELSE 0 END) OVER (PARTITION BY state, grp ORDER BY date) AS run_length FROM g""")
def _(v):
    from quarterhour.operators.features import join_stats
    d = v.load.groupBy("state", "date").agg(F.sum("load").alias("s"))
    d = join_stats(d, ["state"], m=F.avg("s"))
    return run_length_so_far(d, F.col("s") > F.col("m"), ["state"], "date", "run_length")


@query("e10_islands", "state start_date end_date days:i", """
    WITH d AS (SELECT state, date, sum(load) > 4000 AS hot FROM v_load GROUP BY state, date),
    g AS (SELECT *, sum(CASE WHEN hot = p THEN 0 ELSE 1 END) OVER (PARTITION BY state ORDER BY date) AS run FROM (SELECT *, lag(hot) OVER (PARTITION BY state ORDER BY date) AS p FROM d))
    SELECT state, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM g WHERE hot GROUP BY state, run""")
def _(v):
    d = v.load.groupBy("state", "date").agg(F.sum("load").alias("s")).withColumn("hot", F.col("s") > 4000)
    r = run_ids(d, F.col("hot"), ["state"], "date").where("hot")
    return r.groupBy("state", "run_id").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("days"))


@query("e11_degree_hours", "state location date block:i cdh6:f", """
    WITH c AS (SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) * 96 + block AS t, greatest(temperature - 24, 0) AS cd FROM v_wloc),
    s AS (SELECT state, (min(date) - DATE '1970-01-01') * 96 + 1 AS t0 FROM v_wloc GROUP BY state),
    w AS (SELECT c.*, t0, sum(cd) OVER x AS sm, count(cd) OVER x AS n FROM c JOIN s USING (state) WINDOW x AS (PARTITION BY state, location ORDER BY t RANGE BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT state, location, date, block, CASE WHEN t - t0 >= 23 AND n >= 0.5 * 24 THEN sm * (24.0::DOUBLE / n) * 0.25 END AS cdh6 FROM w""")
def _(v):
    return degree_hours(v.wloc, 24, out="cdh6", min_fraction=0.5)


@query("e12_circular_smoothing", "state block:i profile:f profile_smooth:f", """
    WITH p AS (SELECT state, block, avg(load) AS profile FROM v_load GROUP BY state, block), o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k),
    s AS (SELECT p.state, p.block, avg(q.profile) AS profile_smooth FROM p CROSS JOIN o JOIN p q ON q.state = p.state AND q.block = ((p.block + o.k - 1 + 96) % 96) + 1 GROUP BY p.state, p.block)
    SELECT * FROM p JOIN s USING (state, block)""")
def _(v):
    p = v.load.groupBy("state", "block").agg(F.avg("load").alias("profile"))
    return decompose.circular_smooth(p, "profile", 5, ["state"])


@query("e12_edge_padded_smoothing", "state block:i smooth:f", """
    WITH p AS (SELECT state, block, avg(load) AS x FROM v_load GROUP BY state, block), o AS (SELECT unnest([-2, -1, 0, 1]) AS k),
    r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY block) AS rn, count(*) OVER (PARTITION BY state) AS n FROM p)
    SELECT a.state, a.block, avg(b.x) AS smooth FROM r a CROSS JOIN o JOIN r b ON b.state = a.state AND b.rn = least(greatest(a.rn + o.k, 1), a.n) GROUP BY a.state, a.block""")
def _(v):
    p = v.load.groupBy("state", "block").agg(F.avg("load").alias("x"))
    return p.withColumn("smooth", decompose.edge_padded_smooth("x", 4, ["state"]))


@query("e13_savitzky_golay", "state block:i smooth:f", """
    WITH p AS (SELECT state, block, avg(load) AS x FROM v_load GROUP BY state, block),
    n AS (SELECT *, coalesce(lag(x) OVER w, x) AS l1, coalesce(lead(x) OVER w, x) AS r1, lag(x, 2) OVER w AS l2, lead(x, 2) OVER w AS r2 FROM p WINDOW w AS (PARTITION BY state ORDER BY block))
    SELECT state, block, 0.8::DOUBLE * x + 0.2::DOUBLE * greatest(0, (-3 * coalesce(l2, l1) + 12 * l1 + 17 * x + 12 * r1 - 3 * coalesce(r2, r1)) / 35) AS smooth FROM n""")
def _(v):
    p = v.load.groupBy("state", "block").agg(F.avg("load").alias("x"))
    return p.withColumn("smooth", decompose.savgol("x", ["state"]))


@query("e14_recency_weighted_mean", "state block:i wmean:f", """
    WITH m AS (SELECT state, max(date) AS last FROM v_load GROUP BY state)
    SELECT state, block, sum(load * exp(-0.693::DOUBLE * (last - date) / 21)) / sum(exp(-0.693::DOUBLE * (last - date) / 21)) AS wmean FROM v_load JOIN m USING (state) GROUP BY state, block""")
def _(v):
    from quarterhour.operators.features import join_stats
    d = join_stats(v.load, ["state"], last=F.max("date"))
    return d.groupBy("state", "block").agg(decompose.recency_weighted("load", F.datediff("last", "date")).alias("wmean"))


@query("e15_ema_fold", "state date ema:f", """
    SELECT state, date, list_reduce(list(actual / forecast ORDER BY block) FILTER (WHERE forecast > 0), lambda a, x: 0.5::DOUBLE * x + 0.5::DOUBLE * a) AS ema FROM v_pair WHERE forecast > 0 GROUP BY state, date""")
def _(v):
    d = v.pair.where("forecast > 0").withColumn("r", F.col("actual") / F.col("forecast"))
    return decompose.ema_of_day(d, "r", 0.5)


_RAMP = """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY state, date ORDER BY block) AS rn FROM v_pair),
    r AS (SELECT state, date, block, rn, forecast, forecast AS limited FROM o WHERE rn = 1
      UNION ALL SELECT o.state, o.date, o.block, o.rn, o.forecast, CASE WHEN o.block <= 20 THEN o.forecast ELSE least(greatest(o.forecast, r.limited - 60), r.limited + 60) END
      FROM r JOIN o ON o.state = r.state AND o.date = r.date AND o.rn = r.rn + 1)
    SELECT state, date, block, forecast, limited FROM r"""


@query("e16_ramp_limiter", "state date block:i forecast:f limited:f", _RAMP)
def _(v):
    return decompose.ramp_limited(v.pair, "forecast", max_ramp=60.0, settled=20)


@query("e17_median3", "state date block:i m3:f", """
    SELECT state, date, block, list_sort([coalesce(lag(load) OVER w, load), load, coalesce(lead(load) OVER w, load)])[2] AS m3 FROM v_load WINDOW w AS (PARTITION BY state, date ORDER BY block)""")
def _(v):
    return v.load.withColumn("m3", decompose.median3("load", ["state", "date"]))
