"""2.S scalar function families and 2.T user functions, over the supplied tables."""

import pandas as pd
from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import spearman
from quarterhour.functions import numbers as nm
from quarterhour.functions.blocks import block_label, cyclic, parse_hhmm, state_slug
from quarterhour.functions.stats import rank_corr
from quarterhour.operators.features import external_features
from quarterhour.plans.external import day_forecast


@query("s1_math", "event_id:i s:f c:f p:f e:f l:f a:f r:f", """
    SELECT event_id, sin(2 * pi() * (user_id % 96) / 96) AS s, cos(2 * pi() * (user_id % 96) / 96) AS c, pow(value, 2) AS p, exp(-0.693::DOUBLE * value / 21) AS e, ln(1 + value) AS l, atan(0.1::DOUBLE * value) AS a, sqrt(value) AS r FROM events""")
def _(v):
    x = F.col("value")
    s, c = cyclic(F.col("user_id") % 96, 96.0)
    return v.table("events").select("event_id", s.alias("s"), c.alias("c"), F.pow(x, F.lit(2.0)).alias("p"), F.exp(-0.693 * x / 21.0).alias("e"), F.log1p(x).alias("l"), F.atan(0.1 * x).alias("a"), F.sqrt(x).alias("r"))


@query("s6_clip_ratio_change", "o_orderkey:i clipped:f ratio:f change:f", """
    SELECT o_orderkey, least(greatest(o_totalprice, 1000), 200000) AS clipped, o_totalprice / nullif(o_custkey % 7, 0) AS ratio, (o_totalprice - (o_custkey % 5) * 1000) / nullif((o_custkey % 5) * 1000, 0) * 100 AS change FROM orders""")
def _(v):
    base = (F.col("o_custkey") % 5) * 1000.0
    return v.table("orders").select("o_orderkey", nm.clip("o_totalprice", 1000.0, 200000.0).alias("clipped"), nm.ratio("o_totalprice", (F.col("o_custkey") % 7).cast("double")).alias("ratio"), nm.pct_change(F.col("o_totalprice"), base).alias("change"))


@query("s9_dates", "o_orderkey:i next_week name month_name iso_week:i quarter:i day_of_year:i month_start", """
    SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS next_week, dayname(o_orderdate) AS name, monthname(o_orderdate) AS month_name, week(o_orderdate) AS iso_week, quarter(o_orderdate) AS quarter, dayofyear(o_orderdate) AS day_of_year,
      CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders""")
def _(v):
    d = F.to_date("o_orderdate")
    return v.table("orders").select("o_orderkey", F.date_add(d, 7).alias("next_week"), F.date_format(d, "EEEE").alias("name"), F.date_format(d, "MMMM").alias("month_name"), F.weekofyear(d).alias("iso_week"), F.quarter(d).alias("quarter"),
                                    F.dayofyear(d).alias("day_of_year"), F.trunc(d, "month").alias("month_start"))


@query("s13_strings", "event_id:i slug label block:i digest", """
    SELECT event_id, regexp_replace(upper(trim(' ' || event_type || '-x y ')), '[ -]', '_', 'g') AS slug, printf('%02d:%02d', hour(ts), minute(ts) // 15 * 15) AS label, hour(ts) * 4 + minute(ts) // 15 + 1 AS block, substr(sha256(event_type || CAST(event_id AS VARCHAR)), 1, 8) AS digest FROM events""")
def _(v):
    b = parse_hhmm(F.date_format("ts", "HH:mm"))
    return v.table("events").select("event_id", state_slug(F.concat(F.lit(" "), "event_type", F.lit("-x y "))).alias("slug"), block_label(b).alias("label"), b.alias("block"), F.substring(F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256), 1, 8).alias("digest"))


@query("s17_json", "event_id:i k:f back", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, '{"id":' || CAST(event_id AS VARCHAR) || ',"kind":"' || event_type || '"}' AS back FROM events""")
def _(v):
    e = v.table("events")
    return e.select("event_id", F.from_json("props", "k INT")["k"].cast("double").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("back"))


@query("s18_arrays", "state date n:i total:f peak_pos:i first_diff:f padded:i rolled:f", """
    WITH a AS (SELECT state, date, list(load ORDER BY block) AS x FROM v_load GROUP BY state, date)
    SELECT state, date, len(x) AS n, list_sum(x) AS total, list_position(x, list_max(x)) AS peak_pos, x[2] - x[1] AS first_diff, 100 AS padded, x[len(x)] AS rolled FROM a""")
def _(v):
    a = v.load.groupBy("state", "date").agg(F.array_sort(F.collect_list(F.struct("block", "load"))).alias("p")).select("state", "date", F.transform("p", lambda e: e["load"]).alias("x"))
    n = F.size("x")
    pad = F.concat("x", F.array_repeat(F.element_at("x", -1), 100 - n))
    roll = F.concat(F.slice("x", -1, 1), F.slice("x", F.lit(1), n - 1))
    diff = F.zip_with(F.slice("x", F.lit(2), n - 1), F.slice("x", F.lit(1), n - 1), lambda p, q: p - q)
    return a.select("state", "date", n.alias("n"), F.aggregate("x", F.lit(0.0), lambda s, e: s + e).alias("total"), F.array_position("x", F.array_max("x")).alias("peak_pos"), F.try_element_at(diff, F.lit(1)).alias("first_diff"),
                    F.size(pad).alias("padded"), F.element_at(roll, 1).alias("rolled"))


@query("s19_quantiles", "state p10:f median:f p90:f mad:f", """
    WITH m AS (SELECT state, median(load) AS m FROM v_load GROUP BY state)
    SELECT l.state, quantile_cont(load, 0.1) AS p10, median(load) AS median, quantile_cont(load, 0.9) AS p90, median(abs(load - m)) AS mad FROM v_load l JOIN m USING (state) GROUP BY l.state""")
def _(v):
    m = v.load.groupBy("state").agg(F.median("load").alias("m"))
    return v.load.join(m, "state").groupBy("state").agg(F.percentile("load", F.lit(0.1)).alias("p10"), F.median("load").alias("median"), F.percentile("load", F.lit(0.9)).alias("p90"), F.median(F.abs(F.col("load") - F.col("m"))).alias("mad"))


@query("s20_rank_correlation", "state pair rho:f n:i", spearman("v_frame", "state", {"load_temp": ("load", "temperature"), "load_rain": ("load", "precipitation"), "self": ("load", "load")}))
def _(v):
    return rank_corr(v.frame, ["state"], {"load_temp": ("load", "temperature"), "load_rain": ("load", "precipitation"), "self": ("load", "load")})


@query("s21_null_safe_rounding", "event_id:i r:f", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE round(value / 3 + 1e-9, 2) END AS r FROM events")
def _(v):
    x = F.when(F.col("user_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 3 + 1e-9)
    return v.table("events").select("event_id", nm.finite_round(x, 2).alias("r"))


@query("t1_external_features", "state date block:i temp_sq:f is_hot:i", "SELECT state, date, block, temperature * temperature AS temp_sq, CAST(temperature > 30 AS INTEGER) AS is_hot FROM v_frame")
def _(v):
    def extra(df):
        return df.withColumn("temp_sq", F.col("temperature") * F.col("temperature")).withColumn("is_hot", (F.col("temperature") > 30).cast("int"))
    out, added = external_features(v.frame, extra)
    return out.select("state", "date", "block", *added)


@query("t2_external_forecast", "state date block:i forecast:f", """
    SELECT g.state, g.date, g.block, avg(l.load) AS forecast FROM v_grid g JOIN v_load l ON l.state = g.state AND l.date = g.date GROUP BY ALL""")
def _(v):
    def flat(pdf: pd.DataFrame):
        return [pdf["load"].mean()] * 96
    return day_forecast(v.load, flat)


@query("t4_group_aggregates", "state date any_rain energy_mwh:f share_high:f", """
    SELECT state, date, bool_or(precipitation > 0) AS any_rain, sum(load) * 0.25::DOUBLE AS energy_mwh, avg(CASE WHEN load > 100 THEN 1.0::DOUBLE ELSE 0 END) AS share_high FROM v_frame GROUP BY state, date""")
def _(v):
    return v.frame.groupBy("state", "date").agg(F.bool_or(F.col("precipitation") > 0).alias("any_rain"), (F.sum("load") * 0.25).alias("energy_mwh"), F.avg(F.when(F.col("load") > 100, 1.0).otherwise(0.0)).alias("share_high"))
