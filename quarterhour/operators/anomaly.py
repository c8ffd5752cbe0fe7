"""Outliers, jumps, level shifts, alerts and forecast clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import nonneg, pct_change, ratio
from quarterhour.functions.stats import avg_where, count_where, intercept, quantile, share_where, slope
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import blocks_back, core_rows, day_lag, days_ago, sliced

ST = ["state"]
SB = ("state", "block")


def iqr_outliers(df: DataFrame, feature: str = "load", k: float = 1.5) -> DataFrame:
    j = join_stats(df, ST, _q1=quantile(feature, 0.25), _q3=quantile(feature, 0.75))
    iqr = F.col("_q3") - F.col("_q1")
    x = F.col(feature)
    return j.withColumn("is_outlier", (x < F.col("_q1") - k * iqr) | (x > F.col("_q3") + k * iqr)).drop("_q1", "_q3")


def zscore_outliers(df: DataFrame, feature: str = "load", threshold: float = 3.0) -> DataFrame:
    j = join_stats(df, ST, _m=F.avg(feature), _s=F.stddev_pop(feature))
    return j.withColumn("is_outlier", F.coalesce(F.abs(F.col(feature) - F.col("_m")) > threshold * F.col("_s"), F.lit(False))).drop("_m", "_s")


def distortion(flagged: DataFrame, feature: str = "load") -> DataFrame:
    """Count, rate and level difference of the flagged rows."""
    o = F.col("is_outlier")
    return flagged.groupBy("state").agg(
        count_where(o).alias("distortion_count"), (share_where(o) * 100).alias("distortion_rate_pct"),
        pct_change(avg_where(o, feature), avg_where(~o, feature)).alias("deviation_pct"))


def jumps(df: DataFrame, threshold: float) -> DataFrame:
    """Rows whose change to the previous quarter hour is larger than the threshold. Needs ramp."""
    return df.where(F.abs("ramp") > threshold).withColumn("size", F.abs("ramp"))


def z_spikes(df: DataFrame, threshold: float, feature: str = "load") -> DataFrame:
    j = join_stats(df, ST, _m=F.avg(feature), _s=F.stddev_samp(feature))
    return j.withColumn("z", ratio(F.col(feature) - F.col("_m"), "_s")).where(F.abs("z") > threshold).drop("_m", "_s")


def weekly_lag_median(feature: str = "load", weeks: int = 4) -> Column:
    """Median of the same block on the same weekday of the last weeks (those that exist)."""
    lags = F.array_sort(F.array_compact(F.array(*[day_lag(feature, 7 * i) for i in range(1, weeks + 1)])))
    n = F.size(lags)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.ceil((n + 1) / 2.0).cast("int")
    return F.when(n > 0, (F.try_element_at(lags, lo) + F.try_element_at(lags, hi)) / 2.0)


def level_shift_days(df: DataFrame, tolerance: float = 80.0, shift_min: float = 300.0, shift_max: float = 500.0, reversion: float = 100.0,
                     consistency: float = 0.8, feature: str = "load") -> DataFrame:
    """Days shifted as a whole against their weekly baseline that revert on the next day on record."""
    d = df.withColumn("baseline", weekly_lag_median(feature)).withColumn("delta", F.col(feature) - F.col("baseline")).where("baseline is not null")
    med = d.groupBy("state", "date").agg(F.median("delta").alias("daily_shift"))
    day = d.join(med, ["state", "date"]).groupBy("state", "date").agg(
        F.max("daily_shift").alias("daily_shift"), share_where(F.abs(F.col("delta") - F.col("daily_shift")) < tolerance).alias("consistency"))
    day = day.withColumn("next_day_shift", F.lead("daily_shift").over(Window.partitionBy("state").orderBy("date")))
    hit = F.abs("daily_shift").between(shift_min, shift_max) & (F.col("consistency") >= consistency) & (F.abs("next_day_shift") < reversion)
    return day.withColumn("is_event", F.coalesce(hit, F.lit(False)))


def level_shift_xray(df: DataFrame, date: str, feature: str = "load") -> DataFrame:
    """Baseline, event day and following day side by side per block."""
    d = F.lit(date).cast("date")
    j = df.withColumn("baseline", weekly_lag_median(feature)).where(F.col("date").isin(d, F.date_add(d, 1)))
    return j.groupBy("state", "block").agg(
        F.max(F.when(F.col("date") == d, F.col("baseline"))).alias("baseline"), F.max(F.when(F.col("date") == d, F.col(feature))).alias("event_day"),
        F.max(F.when(F.col("date") == F.date_add(d, 1), F.col(feature))).alias("next_day"))


def weather_free_anomalies(df: DataFrame, threshold: float = 2.5, feature: str = "load") -> DataFrame:
    """What remains after the weekday-block median and a temperature regression, flagged where |z| is large."""
    d = df.where(F.col(feature).isNotNull() & F.col("temperature").isNotNull())
    med = d.groupBy("state", "dow", "block").agg(F.median(feature).alias("seasonal"))
    d = d.join(med, ["state", "dow", "block"]).withColumn("_y", F.col(feature) - F.col("seasonal"))
    d = join_stats(d, ST, _b=slope("_y", "temperature"), _a=intercept("_y", "temperature"))
    d = d.withColumn("residual", F.col("_y") - F.coalesce(F.col("_a") + F.col("_b") * F.col("temperature"), F.lit(0.0)))
    d = join_stats(d, ST, _m=F.avg("residual"), _s=F.stddev_samp("residual"))
    z = ratio(F.col("residual") - F.col("_m"), "_s")
    return d.withColumn("z", z).withColumn("is_anomaly", F.coalesce(F.abs("z") > threshold, F.lit(False))).drop("_y", "_a", "_b", "_m", "_s")


def distance_outliers(df: DataFrame, contamination: float = 0.01, columns: tuple[str, ...] = ("load", "hour", "dow")) -> DataFrame:
    """Rows with the largest standardised squared distance, at the given contamination share.

    A row that lacks one of the columns has no distance and is no outlier; a column that never varies adds nothing.
    """
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    stats = {}
    for c in columns:
        value = F.when(known, F.col(c))
        stats[f"_m_{c}"], stats[f"_s_{c}"] = F.avg(value), F.stddev_pop(value)
    j = join_stats(df, ST, **stats)
    d2 = sum((F.coalesce(F.pow(ratio(F.col(c) - F.col(f"_m_{c}"), f"_s_{c}"), F.lit(2.0)), F.lit(0.0)) for c in columns), F.lit(0.0))
    j = j.withColumn("distance2", F.when(known, d2)).drop(*stats)
    j = join_stats(j, ST, _cut=quantile("distance2", 1 - contamination))
    return j.withColumn("is_anomaly", F.coalesce(F.col("distance2") > F.col("_cut"), F.lit(False))).drop("_cut")


def risk_monitor(df: DataFrame, feature: str = "load", window: int = 96) -> DataFrame:
    """Ramp spread over the last 96 quarter hours at the end of the series against its mean, and 7-day momentum."""
    s = sliced(df.select("state", "date", "block", feature, "ramp"), back=window)
    w = Window.partitionBy("state", "_slice").orderBy("t").rangeBetween(-(window - 1), 0)
    full = F.count("ramp").over(w) >= window // 2
    v = core_rows(s.withColumn("vol", F.when(full, F.stddev_samp("ramp").over(w))))
    vol = v.groupBy("state").agg(F.max_by("vol", "t").alias("volatility_index"), F.avg("vol").alias("_mean"), F.max(F.abs("ramp")).alias("max_ramp"))
    d = df.groupBy("state", "date").agg(F.avg(feature).alias("a"))
    o = Window.partitionBy("state").orderBy("date")
    d = d.withColumn("diff", F.col("a") - F.lag("a").over(o)).withColumn("mom", F.when(F.count("diff").over(o.rowsBetween(-6, 0)) >= 7, F.avg("diff").over(o.rowsBetween(-6, 0))))
    m = d.groupBy("state").agg(F.max_by("mom", "date").alias("momentum_mw"))
    return vol.join(m, "state").select(
        "state", F.coalesce("volatility_index", F.lit(0.0)).alias("volatility_index"), "max_ramp", "momentum_mw",
        F.when(F.col("volatility_index") > F.col("_mean") * 1.5, "Elevated").otherwise("Stable").alias("risk_level"),
        F.when(F.col("momentum_mw") > 0, "Increasing").otherwise("Decreasing").alias("momentum"))


def alerts(df: DataFrame, feature: str = "load") -> DataFrame:
    """Prioritised alerts per state: extreme peak, level shift between days, unstable profile."""
    day = df.groupBy("state", "date").agg(F.avg(feature).alias("a"), F.stddev_samp(feature).alias("s"))
    day = day.withColumn("shift", F.abs(F.col("a") - F.lag("a").over(Window.partitionBy("state").orderBy("date"))))
    d = day.groupBy("state").agg(F.max("shift").alias("shift"), F.avg("s").alias("spread"))
    j = df.groupBy("state").agg(F.avg(feature).alias("mean"), F.max(feature).alias("peak")).join(d, "state")
    rule = lambda i, pr, kind, val, lim, conf: F.struct(F.lit(i).alias("order"), F.lit(pr).alias("priority"), F.lit(kind).alias("type"),
                                                        val.alias("value"), lim.alias("limit"), F.lit(conf).alias("confidence"))
    rules = F.array(rule(0, "CRITICAL", "Peak Threshold", F.col("peak"), F.col("mean") * 1.4, 0.95),
                    rule(1, "WARNING", "Base Shift", F.col("shift"), F.col("mean") * 0.15, 0.88),
                    rule(2, "INFO", "Unstable Profile", F.col("spread"), F.col("mean") * 0.2, 0.75))
    return j.select("state", F.explode(rules).alias("r")).select("state", "r.*").where(F.col("value") > F.col("limit"))


def dips_and_rises(df: DataFrame, actual: str = "load", baseline: str = "baseline", threshold_pct: float = 5.0) -> DataFrame:
    d = df.where(F.col(baseline) > 0).withColumn("diff_pct", pct_change(actual, baseline)).where(F.abs("diff_pct") >= threshold_pct)
    return d.withColumn("kind", F.when(F.col("diff_pct") < 0, "dip").otherwise("rise")).withColumn("magnitude", F.col(actual) - F.col(baseline))


def day_anomalies(df: DataFrame, limit: float = 0.06, window: int = 7, feature: str = "load") -> DataFrame:
    """Days whose mean leaves the mean of the trailing days by more than the limit, and the days right after them."""
    d = df.groupBy("state", "date").agg(F.avg(feature).alias("mean"))
    w = days_ago(ST, window, 1)
    d = d.withColumn("trailing_mean", F.when(F.count("mean").over(w) >= 2, F.avg("mean").over(w)))
    d = d.withColumn("anomalous", F.coalesce(F.abs(ratio(F.col("mean") - F.col("trailing_mean"), "trailing_mean")) > limit, F.lit(False)))
    after = F.coalesce(F.max(F.col("anomalous").cast("int")).over(days_ago(ST, 1)), F.lit(0)) == 1
    return d.withColumn("excluded", F.col("anomalous") | after)


def outage_days(df: DataFrame, drop: float = 0.30, wind_limit: float = 65.0, wind: str = "wind_speed_10m", feature: str = "load", floor: float = 500.0) -> DataFrame:
    """Days with a fall of more than ``drop`` within four blocks, or with storm wind."""
    lag4 = F.max(feature).over(Window.partitionBy("state", "date").orderBy("block").rangeBetween(-4, -4))
    d = df.withColumn("_l", lag4).withColumn("_r", F.when(F.col("_l") > floor, ratio(F.col(feature) - F.col("_l"), "_l")))
    return d.groupBy("state", "date").agg(F.coalesce(F.bool_or(F.col("_r") < -drop), F.lit(False)).alias("sharp_drop"),
                                          F.coalesce(F.bool_or(F.col(wind) >= wind_limit), F.lit(False)).alias("storm_wind")).withColumn(
        "outage", F.col("sharp_drop") | F.col("storm_wind"))


def previous_night_dip(df: DataFrame, limit: float = 0.15, window: int = 7, night: tuple[int, int] = (1, 32), feature: str = "load") -> DataFrame:
    """Night mean of the day before against the nights of the week before it."""
    d = df.where(F.col("block").between(*night)).groupBy("state", "date").agg(F.avg(feature).alias("night_mean"))
    w = days_ago(ST, window, 1)
    d = d.withColumn("trailing_mean", F.when(F.count("night_mean").over(w) >= 2, F.avg("night_mean").over(w)))
    d = d.withColumn("dip", F.coalesce(F.col("night_mean") < (1 - limit) * F.col("trailing_mean"), F.lit(False)))
    return d.withColumn("prev_night_dip", F.coalesce(F.max(F.col("dip").cast("int")).over(days_ago(ST, 1)), F.lit(0)))


def sigma_clamp(df: DataFrame, forecast: str = "forecast", feature: str = "actual", start: float = 2.5, max_pull: float = 0.7, window: int = 14,
                min_sigma: float = 50.0, min_days: int = 3) -> DataFrame:
    """Progressive pull toward the block's recent mean: none at ``start`` sigma, ``max_pull`` from twice that on.

    The mean and the (population, floored) spread come from the days before only. ``sigmas`` is the distance used.
    """
    w = days_ago(SB, window, 1)
    d = df.withColumn("hist_mean", F.avg(feature).over(w)).withColumn("_n", F.count(feature).over(w))
    d = d.withColumn("hist_std", F.greatest(F.stddev_pop(feature).over(w), F.lit(min_sigma)))
    d = d.withColumn("sigmas", F.when(F.col("_n") >= min_days, F.abs(F.col(forecast) - F.col("hist_mean")) / F.col("hist_std")))
    pull = F.least(F.lit(max_pull), (F.col("sigmas") - start) / start * max_pull)
    out = F.when(F.col("sigmas") > start, F.col(forecast) * (1 - pull) + F.col("hist_mean") * pull).otherwise(F.col(forecast))
    return d.withColumn("clamped", nonneg(out)).drop("_n")


def drastic_scores(clamped: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Mean distance in sigmas per day, and whether the day before was marked unstable."""
    d = clamped.groupBy("state", "date").agg(F.avg("sigmas").alias("score"))
    prev = F.max(F.when(F.col("score") >= threshold, 1).otherwise(0)).over(days_ago(ST, 1))
    return d.withColumn("unstable", F.coalesce(F.col("score") >= threshold, F.lit(False))).withColumn("prev_unstable", F.coalesce(prev, F.lit(0)))


def trend_corridor(df: DataFrame, z: float = 2.0, window: int = 7, forecast: str = "forecast", feature: str = "actual") -> DataFrame:
    """Forecasts outside z sigma of the trend path take the path.

    The path starts at the last quarter hour of the day before and adds, block by block, the mean slope that the
    block had over the last days; sigma is the spread of that slope.
    """
    s = core_rows(sliced(df, back=1).withColumn("_prev", blocks_back(feature, 1)))
    s = s.withColumn("_slope", F.col(feature) - F.col("_prev"))
    w = days_ago(SB, window, 1)
    s = s.withColumns({"slope_mean": F.avg("_slope").over(w), "slope_std": F.stddev_pop("_slope").over(w)})
    day = Window.partitionBy("state", "date").orderBy("block")
    base = F.max(F.when(F.col("block") == 1, F.col("_prev"))).over(Window.partitionBy("state", "date"))
    path = base + F.sum(F.coalesce("slope_mean", F.lit(0.0))).over(day.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("trend_path", path)
    out = F.coalesce((F.col("slope_std") > 0) & (F.abs(F.col(forecast) - F.col("trend_path")) > z * F.col("slope_std")), F.lit(False))
    return s.withColumn("outside", out).withColumn("patched", F.when(F.col("outside"), F.col("trend_path")).otherwise(F.col(forecast))).drop("_prev", "_slope", "t")
