"""Forecast accuracy, backtest tables and monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import avg_where, count_where, quantile, share_where, sum_where, top_by
from quarterhour.operators.calendar import daypart, season_maps
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import days_ago

DAY = ["state", "date"]
PEAK_BLOCKS = (69, 92)


def pairs(df: DataFrame) -> DataFrame:
    """Rows where both actual and forecast are known."""
    return df.where(F.col("actual").isNotNull() & F.col("forecast").isNotNull())


def wape(cond: Column | None = None) -> Column:
    e, a = F.abs(F.col("actual") - F.col("forecast")), F.abs(F.col("actual"))
    if cond is not None:
        e, a = F.when(cond, e), F.when(cond, a)
    return F.try_divide(F.sum(e), F.sum(a)) * 100.0


def metrics(df: DataFrame, keys: Sequence[str] = ("state",), peak: tuple[int, int] = PEAK_BLOCKS) -> DataFrame:
    """WAPE, accuracy, MAE, RMSE, bias, peak WAPE, daily peak error, upper quantiles of the absolute error, and with
    p10 / p90 the pinball loss and interval coverage. Quantiles are exact: a key holds one model and calendar.
    """
    keys = list(keys)
    d = pairs(df)
    e = F.col("forecast") - F.col("actual")
    aggs = [F.count(F.lit(1)).alias("n"), wape().alias("wape"), (100.0 - wape()).alias("accuracy_wape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias_mw"),
            wape(F.col("block").between(*peak)).alias("peak_wape"), quantile(F.abs(e), 0.9).alias("p90_abs_error"), quantile(F.abs(e), 0.95).alias("p95_abs_error")]
    if "p10" in df.columns:
        inside = (F.col("actual") >= F.col("p10")) & (F.col("actual") <= F.col("p90"))
        known = F.col("p10").isNotNull() & F.col("p90").isNotNull()
        aggs += [pinball().alias("pinball_loss"), (avg_where(known, F.when(inside, 1.0).otherwise(0.0)) * 100).alias("coverage_pct")]
    a = d.groupBy(*keys).agg(*aggs)
    day_keys = list(dict.fromkeys([*keys, "state", "date"]))
    pk = d.groupBy(*day_keys).agg(F.abs(F.max("forecast") - F.max("actual")).alias("_pe")).groupBy(*keys).agg(F.avg("_pe").alias("daily_peak_error"))
    return a.join(pk, keys)


def pinball(levels: Sequence[tuple[str, float]] = (("p10", 0.1), ("forecast", 0.5), ("p90", 0.9))) -> Column:
    """Mean pinball loss over the quantile columns."""
    loss = F.lit(0.0)
    for c, q in levels:
        d = F.col("actual") - F.col(c)
        loss = loss + F.greatest(q * d, (q - 1) * d)
    return F.avg(F.when(F.col("p10").isNotNull() & F.col("p90").isNotNull(), loss / len(levels)))


def daily_metrics(df: DataFrame, keys: Sequence[str] = ("state", "date")) -> DataFrame:
    d = pairs(df)
    e = F.abs(F.col("forecast") - F.col("actual"))
    return d.groupBy(*keys).agg(wape().alias("wape"), F.avg(e).alias("mae"), F.abs(F.max("forecast") - F.max("actual")).alias("peak_error_mw"))


def rel_error() -> Column:
    return F.abs(F.col("actual") - F.col("forecast")) / F.greatest("actual", F.lit(1e-6))


def kpi_summary(df: DataFrame) -> DataFrame:
    """Thirteen day KPIs: error level, peak and energy, shares within 2 / 5 / over 10 %, reserve margin, confidence."""
    r, e = rel_error(), F.col("forecast") - F.col("actual")
    d = pairs(df).groupBy(*DAY).agg(
        (F.avg(r) * 100).alias("mape"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (F.abs(F.max("actual") - F.max("forecast")) / F.greatest(F.max("actual"), F.lit(1e-6)) * 100).alias("peak_accuracy"),
        (F.abs(F.sum("actual") - F.sum("forecast")) / F.greatest(F.sum("actual"), F.lit(1e-6)) * 100).alias("daily_energy_error"), F.max("forecast").alias("peak_load"), F.sum("forecast").alias("daily_energy"),
        (share_where(r <= 0.02) * 100).alias("within_2pct"), (share_where(r <= 0.05) * 100).alias("within_5pct"), (share_where(r > 0.10) * 100).alias("over_10pct"))
    return d.withColumn("reserve_margin", F.when(F.col("peak_load") > 0, 18.0)).withColumn("confidence", F.greatest(F.lit(60.0), 95.0 - F.col("mape") * 1.2)).withColumn(
        "peak_status", F.when(F.col("peak_accuracy") > 3, "warning").otherwise("ok"))


def peak_class(gap: Column) -> Column:
    return F.when(gap == 0, "Exact match").when(gap <= 2, "Close").when(gap <= 4, "Moderate error").otherwise("Poor")


def peak_time(df: DataFrame) -> DataFrame:
    """Blocks of the actual and the forecast peak and the class of their distance."""
    d = pairs(df).groupBy(*DAY).agg(top_by("block", "actual", "block").alias("actual_peak_block"), top_by("block", "forecast", "block").alias("forecast_peak_block"))
    g = F.abs(F.col("actual_peak_block") - F.col("forecast_peak_block"))
    return d.withColumn("block_error", g).withColumn("category", peak_class(g))


def full_kpis(df: DataFrame) -> DataFrame:
    """The wide day table: accuracy, ramp accuracy, weather attribution, dips, time windows, peak attribution.

    Needs actual, forecast, baseline and the weather with its normals (temperature, n_temp, ...). One aggregation
    over the day's blocks.
    """
    from quarterhour.operators.attribution import contributions
    from quarterhour.operators.day_stats import DELTA_WINDOWS, in_window
    d = contributions(pairs(df))
    r, b = rel_error(), F.col("block")
    dev = F.col("actual") - F.col("baseline")
    pct = ratio(dev, "baseline") * 100
    day = Window.partitionBy(*DAY).orderBy("block")
    d = d.withColumn("_r", F.abs(F.col("actual") - F.max("actual").over(day.rangeBetween(-1, -1))))
    ramp = b.between(24, 43) | b.between(64, 76)
    parts = ("temperature_mw", "humidity_mw", "precipitation_mw")
    top = lambda c: F.max_by(c, F.struct("actual", -F.col("block")))
    a = d.groupBy(*DAY).agg(
        (F.avg(r) * 100).alias("mape"), F.sqrt(F.avg(F.pow(F.col("actual") - F.col("forecast"), F.lit(2.0)))).alias("rmse_mw"), F.avg(F.col("forecast") - F.col("actual")).alias("bias_mw"),
        (share_where(r <= 0.02) * 100).alias("within_2pct"), (avg_where(ramp, F.when(r <= 0.02, 1.0).otherwise(0.0)) * 100).alias("ramp_within_2pct"),
        *[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in parts], F.abs(F.sum(dev) - F.coalesce(F.sum(sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))), F.lit(0.0))).alias("unexplained_mw"),
        count_where(pct <= -5).alias("dips"), count_where(pct >= 5).alias("rises"), F.max("_r").alias("max_ramp"),
        *[F.coalesce(sum_where(in_window("block", lo, hi), dev), F.lit(0.0)).alias(f"{n}_delta_mw") for n, lo, hi in DELTA_WINDOWS],
        (F.max("actual") / (F.max("forecast") * 1.05 + 1e-6) * 100).alias("commitment_alignment_pct"), *[top(p).alias(f"peak_{p}") for p in parts],
        F.abs(top_by("block", "actual", "block") - top_by("block", "forecast", "block")).alias("block_error"))
    return a.withColumn("category", peak_class(F.col("block_error")))


def temp_regime(t: Column) -> Column:
    return F.when(t.isNull(), "Unknown").when(t >= 38, "Hot").when(t >= 25, "Warm").when(t >= 15, "Mild").otherwise("Cold")


def backtest_days(df: DataFrame, settled: int = 36, floor: float = 10.0, min_blocks: int = 10) -> DataFrame:
    """Error rows per (state, model, date) over the blocks after the settled ones, with the day's strata and weather flag.

    ``df`` may hold several models; it needs actual, forecast and temperature.
    """
    keys = [c for c in ("model", "horizon") if c in df.columns]
    b = F.col("block")
    ok = (b > settled) & (F.col("actual") > floor) & F.col("forecast").isNotNull()
    r = F.abs(F.col("forecast") - F.col("actual")) / F.greatest("actual", F.lit(1.0))
    e = F.col("forecast") - F.col("actual")
    d = df.groupBy(*keys, *DAY).agg(
        count_where(ok).alias("blocks"), (avg_where(ok, r) * 100).alias("mape"), F.sqrt(avg_where(ok, e * e)).alias("rmse"),
        (F.try_divide(sum_where(ok, e), F.greatest(sum_where(ok, "actual"), F.lit(4.0))) * 100).alias("energy_error_pct"), (avg_where(ok & b.between(49, 72), r) * 100).alias("peak_mape"),
        F.avg("temperature").alias("avg_temp"), F.max(F.when(ok, F.col("actual"))).alias("peak_load"))
    t = F.col("avg_temp")
    flag = F.when(t >= 38, "extreme").when(t >= 32, "high").when(t <= 15, "cold").otherwise("normal")
    return d.where(F.col("blocks") >= min_blocks).withColumns({
        "day_type": F.when(F.weekday("date") >= 5, "Weekend").otherwise("Weekday"), "season": season_maps(F.month("date"))[2], "temp_regime": temp_regime(t), "weather_flag": flag})


def backtest_strata(days: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    """Overall, by season, day type and temperature regime in one pass of grouping sets."""
    keys = list(keys)
    s = ["season", "day_type", "temp_regime"]
    g = days.groupingSets([keys, *[[*keys, c] for c in s]], *keys, *s).agg(
        F.count(F.lit(1)).alias("n"), F.avg("mape").alias("mape_mean"), F.median("mape").alias("mape_median"), F.avg("rmse").alias("rmse_mean"), F.avg("peak_mape").alias("peak_mape_mean"),
        F.grouping_id().alias("_g"))
    return g.drop("_g")


def backtest_summary(days: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    m = F.col("mape")
    we = F.col("day_type") == "Weekend"
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_days"), F.avg(m).alias("mape_mean"), F.median(m).alias("mape_median"), F.min(m).alias("mape_min"), F.max(m).alias("mape_max"), quantile(m, 0.9).alias("mape_p90"),
        F.avg("rmse").alias("rmse_mean"), F.avg("energy_error_pct").alias("energy_error_mean"), F.avg("peak_mape").alias("peak_mape_mean"), count_where(m < 3).alias("days_under_3pct"), count_where(m < 5).alias("days_under_5pct"),
        avg_where(we, m).alias("weekend_mape"), avg_where(~we, m).alias("weekday_mape"))


def champion_challenger(days: DataFrame, champion: str, challenger: str) -> DataFrame:
    """Mean MAPE of two models on their common dates and the promotion decision."""
    p = days.where(F.col("model").isin(champion, challenger)).groupBy("state", "date").agg(
        F.max(F.when(F.col("model") == champion, F.col("mape"))).alias("a"), F.max(F.when(F.col("model") == challenger, F.col("mape"))).alias("b")).where("a is not null and b is not null")
    s = p.groupBy("state").agg(F.count(F.lit(1)).alias("n_days"), F.avg("a").alias("champion_mape"), F.avg("b").alias("challenger_mape"))
    wins = F.col("challenger_mape") < F.col("champion_mape")
    return s.withColumn("improvement", F.col("champion_mape") - F.col("challenger_mape")).withColumn("challenger_wins", wins).withColumn(
        "recommendation", F.when(wins, "promote_challenger").otherwise("keep_champion"))


def live_errors(df: DataFrame, floor: float = 10.0) -> DataFrame:
    ok = (F.col("actual") > floor) & (F.col("forecast") > floor)
    return df.withColumn("ape", F.when(ok, F.abs(F.col("actual") - F.col("forecast")) / F.greatest("actual", F.lit(1.0)) * 100))


def live_accuracy(df: DataFrame, settled: int = 96, run: int = 8, limit: float = 5.0) -> DataFrame:
    """Running MAPE of the day, drift alert (a run of blocks over the limit; unusable and missing blocks break it), worst three blocks."""
    d = live_errors(df.where(F.col("block") <= settled))
    d = d.withColumn("_bad", F.coalesce(F.col("ape") > limit, F.lit(False)))
    d = d.withColumn("_grp", F.col("block") - F.row_number().over(Window.partitionBy(*DAY, "_bad").orderBy("block")))  # a missing block ends a run, too
    d = d.withColumn("_run", F.when(F.col("_bad"), F.row_number().over(Window.partitionBy(*DAY, "_bad", "_grp").orderBy("block"))).otherwise(0))
    worst = F.slice(F.reverse(F.array_sort(F.collect_list(F.when(F.col("ape").isNotNull(), F.struct("ape", (-F.col("block")).alias("nb")))))), 1, 3)
    a = d.groupBy(*DAY).agg(F.avg("ape").alias("current_mape"), F.count(F.lit(1)).alias("settled_blocks"), F.max("_run").alias("longest_run"), worst.alias("_w"))
    alert = F.col("longest_run") >= run
    return a.select(*DAY, "current_mape", "settled_blocks", "longest_run", alert.alias("drift_alert"), (alert & (F.col("settled_blocks") < 72)).alias("recalibrate"),
                    F.array_join(F.transform("_w", lambda x: (-x["nb"]).cast("string")), ",").alias("worst_blocks"))


def model_performance(days: DataFrame, window: int = 7, drift: float = 0.20) -> DataFrame:
    """Rolling MAPE per date, drift against the window before, best and worst day of the model."""
    keys = [c for c in ("model",) if c in days.columns]
    k = ["state", *keys]
    w, p = days_ago(k, window - 1, 0), days_ago(k, 2 * window - 1, window)
    d = days.withColumn("rolling_mape", F.avg("mape").over(w)).withColumn("prior_mape", F.avg("mape").over(p))
    d = d.withColumn("drift", F.coalesce(F.col("rolling_mape") > (1 + drift) * F.col("prior_mape"), F.lit(False)))
    ext = days.groupBy(*k).agg(F.min_by("date", F.struct("mape", "date")).alias("best_day"), F.max_by("date", F.struct(F.col("mape"), -F.datediff("date", F.lit("1970-01-01").cast("date")))).alias("worst_day"))
    return d.join(ext, k)


def history_trend(days: DataFrame, n: int = 14) -> DataFrame:
    """First against second half of the last n days: MAPE improvement and whether the bias falls. Needs mape, bias."""
    o = Window.partitionBy("state").orderBy(F.desc("date"))
    d = days.withColumn("_r", F.row_number().over(o)).where(F.col("_r") <= n)
    d = join_stats(d, ["state"], _n=F.count(F.lit(1)))
    second = F.col("_r") <= F.col("_n") - F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    s = d.groupBy("state").agg(avg_where(~second, "mape").alias("first_half"), avg_where(second, "mape").alias("second_half"), avg_where(~second, "bias").alias("_b1"), avg_where(second, "bias").alias("_b2"))
    return s.select("state", "first_half", "second_half", (ratio(F.col("first_half") - F.col("second_half"), "first_half") * 100).alias("improvement_pct"), (F.col("_b2") - F.col("_b1") < 0).alias("bias_improving"))


def psi_drift(days: DataFrame, window: int = 7, bins: int = 5) -> DataFrame:
    """Population stability index of the daily MAPE: last window against the one before, equal-width bins from 0 to the maximum."""
    o = Window.partitionBy("state").orderBy(F.desc("date"))
    d = days.withColumn("_r", F.row_number().over(o)).where(F.col("_r") <= 2 * window)
    d = join_stats(d, ["state"], _mx=F.max("mape"))
    width = (F.col("_mx") + 1e-6) / bins
    d = d.withColumn("bin", F.least(F.floor(F.col("mape") / width) + 1, F.lit(bins))).withColumn("_new", F.col("_r") <= window)
    tot = d.groupBy("state").agg(count_where(F.col("_new")).alias("_rt"), count_where(~F.col("_new")).alias("_bt"))
    grid = d.select("state").distinct().withColumn("bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))))
    c = grid.join(d.groupBy("state", "bin").agg(count_where(F.col("_new")).alias("r"), count_where(~F.col("_new")).alias("b")), ["state", "bin"], "left").join(tot, "state")
    share = lambda x, t: F.when(F.coalesce(x, F.lit(0)) == 0, 1e-4).otherwise(F.col(x) / F.greatest(t, F.lit(1)))
    c = c.withColumn("_ps", share("r", "_rt")).withColumn("_pb", share("b", "_bt"))
    return c.groupBy("state").agg(F.greatest(F.lit(0.0), F.sum((F.col("_ps") - F.col("_pb")) * F.ln(F.col("_ps") / F.col("_pb")))).alias("psi"))


def demand_response(df: DataFrame, n: int = 14, q: float = 0.95) -> DataFrame:
    """Confusion counts of 'peak above the q-quantile of recent actual peaks' between forecast and actual."""
    d = pairs(df).groupBy(*DAY).agg(F.max("actual").alias("ap"), F.max("forecast").alias("fp"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= n)
    d = join_stats(d, ["state"], threshold=quantile("ap", q))
    need, pred = F.col("ap") > F.col("threshold"), F.col("fp") > F.col("threshold")
    s = d.groupBy("state").agg(F.max("threshold").alias("threshold"), count_where(pred & need).alias("tp"), count_where(~pred & ~need).alias("tn"), count_where(pred & ~need).alias("fp"), count_where(~pred & need).alias("fn"))
    return s.withColumn("accuracy_pct", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")) * 100)


# Default prices per MWh and per MW.
TARIFFS = {"energy": 80.0, "capacity": 5.0, "ancillary": 10.0, "fuel": 50.0}


def financials(df: DataFrame, tariffs: dict[str, float] | None = None) -> DataFrame:
    """Cost of energy, capacity, ancillary and fuel deviations per day."""
    t = {**TARIFFS, **(tariffs or {})}
    d = pairs(df).groupBy(*DAY).agg(F.abs(F.sum("actual") - F.sum("forecast")).alias("_e"), F.abs(F.max("forecast") - F.max("actual")).alias("_p"), F.max("forecast").alias("_fp"))
    return d.select(*DAY, (F.col("_e") * t["energy"]).alias("energy_cost_variance"), (100.0 - F.col("_p") * t["capacity"] / (F.col("_fp") * t["capacity"] + 1e-6) * 100).alias("capacity_efficiency"),
                    (F.col("_p") * t["ancillary"]).alias("ancillary_cost"), (F.col("_p") * t["fuel"]).alias("fuel_cost_variance"))


def block_errors(df: DataFrame) -> DataFrame:
    e = F.col("forecast") - F.col("actual")
    return pairs(df).groupBy("state", "block").agg((F.avg(rel_error()) * 100).alias("mape"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("std"), F.count(F.lit(1)).alias("n"))


def recommendations(df: DataFrame) -> DataFrame:
    """Rule rows from the error profile: bias, peak and night weakness, high spread."""
    b = F.col("block")
    s = block_errors(df).groupBy("state").agg(
        F.avg("bias").alias("bias"), F.avg("mape").alias("mape"), avg_where(b.between(48, 72), "mape").alias("peak_mape"), avg_where(b <= 24, "mape").alias("night_mape"), F.avg("std").alias("std"))
    rule = lambda i, t, v, hit: F.when(hit, F.struct(F.lit(i).alias("rule"), F.lit(t).alias("text"), v.alias("value")))
    rules = F.array_compact(F.array(
        rule(1, "systematic over-forecast", F.col("bias"), F.col("bias") > 0.02 * F.col("std")), rule(2, "systematic under-forecast", F.col("bias"), F.col("bias") < -0.02 * F.col("std")),
        rule(3, "peak blocks above average error", F.col("peak_mape"), F.col("peak_mape") > F.col("mape")), rule(4, "night blocks above average error", F.col("night_mape"), F.col("night_mape") > F.col("mape"))))
    return s.select("state", F.explode(rules).alias("r")).select("state", "r.*")


def blend_search(df: DataFrame, a: str, b: str, steps: int = 10) -> DataFrame:
    """Grid search of the weight of model a against b: all candidate weights are scored in one aggregation."""
    p = df.where(F.col("model").isin(a, b)).groupBy("state", "date", "block").agg(
        F.max("actual").alias("actual"), F.max(F.when(F.col("model") == a, F.col("forecast"))).alias("fa"), F.max(F.when(F.col("model") == b, F.col("forecast"))).alias("fb")).where("actual > 10 and fa is not null and fb is not null")
    err = lambda w: F.avg(F.abs(F.col("actual") - (w * F.col("fa") + (1 - w) * F.col("fb"))) / F.col("actual")) * 100
    g = p.groupBy("state").agg(*[err(i / steps).alias(f"w{i}") for i in range(steps + 1)])
    return g.select("state", F.explode(F.array(*[F.struct(F.lit(i / steps).alias("weight"), F.col(f"w{i}").alias("mape")) for i in range(steps + 1)])).alias("x")).select("state", "x.*")


SEGMENTS = [("night", 1, 32), ("morning", 33, 48), ("afternoon", 49, 72), ("evening", 73, 96)]


def segment_root_cause(df: DataFrame, context: DataFrame) -> DataFrame:
    """Error per day segment, worst segment, under-forecast share and reason text. ``context``: state, date, factors."""
    d = pairs(df).withColumn("segment", daypart("block", SEGMENTS))
    e = F.col("forecast") - F.col("actual")
    s = d.groupBy(*DAY, "segment").agg((F.avg(rel_error()) * 100).alias("mape"), F.avg(e).alias("bias"), (share_where(e < 0) * 100).alias("under_pct"))
    w = Window.partitionBy(*DAY)
    s = s.withColumn("is_worst", F.row_number().over(w.orderBy(F.desc("mape"), "segment")) == 1)
    lean = F.when(F.col("under_pct") >= 65, "Persistent under-forecast.").when(F.col("under_pct") <= 35, "Persistent over-forecast.").otherwise("Mixed error direction.")
    return s.join(context, DAY, "left").withColumn("reason", F.concat_ws(" ", lean, F.when(F.col("is_worst"), F.concat(F.lit("Worst segment: "), "segment", F.lit("."))), "factors")).drop("factors")


def skill_score(df: DataFrame, floor: float = 10.0, min_blocks: int = 10) -> DataFrame:
    """Improvement of the forecast's MAPE over yesterday's load as forecast, per day. Needs ``persistence``."""
    ok = (F.col("actual") > floor) & F.col("forecast").isNotNull() & F.col("persistence").isNotNull()
    m = lambda c: avg_where(ok, F.abs(F.col(c) - F.col("actual")) / F.col("actual")) * 100
    d = df.groupBy(*DAY).agg(m("forecast").alias("model_mape"), m("persistence").alias("persistence_mape"), count_where(ok).alias("n"), avg_where(ok, F.col("forecast") - F.col("actual")).alias("bias"))
    return d.where(F.col("n") >= min_blocks).withColumn("skill_pct", ratio(F.col("persistence_mape") - F.col("model_mape"), "persistence_mape") * 100)


def day_type_match(df: DataFrame) -> DataFrame:
    """1 minus the error of the mean profile of a day's type (weekday / weekend) against the day."""
    p = df.groupBy("state", "is_weekend", "block").agg(F.avg("load").alias("_p"))
    j = df.join(p, ["state", "is_weekend", "block"])
    return j.groupBy(*DAY).agg((1.0 - F.avg(F.abs(F.col("load") - F.col("_p")) / F.greatest("load", F.lit(1e-6)))).alias("match_quality"))


def horizon_comparison(df: DataFrame) -> DataFrame:
    """T+1 and T+2 MAPE, accuracy and peak MAPE per target date on one row. Needs horizon (1 or 2)."""
    r = F.abs(F.col("forecast") - F.col("actual")) / F.greatest("actual", F.lit(1.0))
    ok = (F.col("actual") > 10) & F.col("forecast").isNotNull()
    cols = []
    for h in (1, 2):
        c = ok & (F.col("horizon") == h)
        cols += [(avg_where(c, r) * 100).alias(f"t{h}_mape"), (100 - avg_where(c, r) * 100).alias(f"t{h}_accuracy"), (avg_where(c & F.col("block").between(48, 72), r) * 100).alias(f"t{h}_peak_mape")]
    return df.groupBy(*DAY).agg(*cols)
