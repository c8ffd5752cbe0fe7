"""KPI tables per state. Every function is one or a few aggregations; keys can be widened (for example by hour)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import pct_change, ratio
from quarterhour.functions.stats import avg_where, bottom_by, count_where, kurt_sample, quantile, rank_corr_wide, share_where, skew_sample, slope, top_by
from quarterhour.operators.calendar import holiday_flag
from quarterhour.operators.features import day_context, join_stats, rolling_spread, volatility_flag
from quarterhour.operators.grid import run_ids

ST = ["state"]


def standard(df: DataFrame, feature: str = "load", keys: Sequence[str] = ST) -> DataFrame:
    """Average, peak, volatility (sample) and number of points. ``keys`` with hour gives the per-hour fan-out."""
    return df.groupBy(*keys).agg(F.avg(feature).alias("average"), F.max(feature).alias("peak"),
                                 F.stddev_samp(feature).alias("volatility"), F.count(feature).alias("points"))


def on_hourly_means(df: DataFrame, feature: str = "load") -> DataFrame:
    return standard(df.groupBy("state", "date", "hour").agg(F.avg(feature).alias(feature)), feature)


def standard_and_hourly(df: DataFrame, feature: str = "load") -> DataFrame:
    """Whole-range KPIs (hour NULL) and the 24 per-hour ones in one job over grouping sets."""
    return df.groupingSets([["state"], ["state", "hour"]], "state", "hour").agg(
        F.avg(feature).alias("average"), F.max(feature).alias("peak"), F.stddev_samp(feature).alias("volatility"), F.count(feature).alias("points"))


def block_profile(df: DataFrame, feature: str = "load") -> DataFrame:
    return df.groupBy("state", "block").agg(F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("std"))


def block_summary(df: DataFrame, feature: str = "load") -> DataFrame:
    """Peak block, most volatile block and average block volatility."""
    p = block_profile(df, feature)
    return p.groupBy("state").agg(top_by("block", "mean", "block").alias("peak_load_block"),
                                  top_by("block", "std", "block").alias("most_volatile_block"), F.avg("std").alias("avg_volatility"))


def fair_weather_base(df: DataFrame) -> DataFrame:
    """Median load per season, day type and block on fair-weather rows; the relaxed rule applies where none qualify."""
    t = F.col("temperature")
    strict = t.between(15, 22) & (F.col("precipitation") <= 0.1) & F.col("humidity").between(30, 70)
    loose = t.between(15, 25)
    any_strict = df.groupBy("state").agg(F.max(F.when(strict, 1).otherwise(0)).alias("_any"))
    fair = df.join(any_strict, "state").where(F.when(F.col("_any") == 1, strict).otherwise(loose))
    return fair.groupBy("state", "season", "is_weekend", "block").agg(F.median("load").alias("base_load_mw"))


def daily(df: DataFrame, feature: str = "load") -> DataFrame:
    return df.groupBy("state", "date").agg(F.avg(feature).alias("avg"), F.max(feature).alias("max"), F.min(feature).alias("min"), F.sum(feature).alias("total"))


def day_order(desc: bool = False):
    return Window.partitionBy("state").orderBy(F.desc("date") if desc else F.col("date"))


def over_previous_day(df: DataFrame, feature: str = "load", top: int = 20) -> DataFrame:
    """The ``top`` days with the largest rise of the daily mean over the previous day on record."""
    d = daily(df, feature).withColumn("prev_avg", F.lag("avg").over(day_order()))
    d = d.withColumn("delta", F.col("avg") - F.col("prev_avg")).withColumn("delta_pct", pct_change("avg", "prev_avg"))
    w = Window.partitionBy("state").orderBy(F.desc("delta"), "date")
    return d.where("delta > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def over_previous_day_kpis(df: DataFrame, feature: str = "load", rain: str = "precipitation") -> DataFrame:
    """Counts and sizes of rises and falls, and the exceed rate on wet and on dry days."""
    d = df.groupBy("state", "date").agg(F.avg(feature).alias("avg"), F.sum(rain).alias("rain"))
    d = d.withColumn("delta", F.col("avg") - F.lag("avg").over(day_order()))
    up, wet = F.coalesce(F.col("delta") > 0, F.lit(False)), F.coalesce(F.col("rain") > 0.1, F.lit(False))
    return d.groupBy("state").agg(
        count_where(up).alias("days_exceeding"), count_where(F.col("delta") < 0).alias("days_below"), F.count("delta").alias("total_days"),
        avg_where(up, "delta").alias("avg_increase"), F.max("delta").alias("max_increase"), F.min("delta").alias("max_decrease"),
        (avg_where(wet, F.when(up, 1.0).otherwise(0.0)) * 100).alias("wet_exceed_rate"),
        (avg_where(~wet, F.when(up, 1.0).otherwise(0.0)) * 100).alias("dry_exceed_rate"))


def weekly_pattern(df: DataFrame, feature: str = "load", wide: bool = False) -> DataFrame:
    """Mean per weekday and block; ``wide`` gives one column per weekday."""
    if not wide:
        return df.groupBy("state", "dow", "block").agg(F.avg(feature).alias("mean"))
    return df.groupBy("state", "block").agg(*[avg_where(F.col("dow") == d, feature).alias(f"dow_{d}") for d in range(7)])


def hourly_cycle(df: DataFrame, feature: str = "load") -> DataFrame:
    h = df.groupBy("state", "hour").agg(F.avg(feature).alias("mean"))
    return h.groupBy("state").agg(top_by("hour", "mean", "hour").alias("peak_hour"), bottom_by("hour", "mean", "hour").alias("valley_hour"),
                                  F.max("mean").alias("peak_mean"), F.min("mean").alias("valley_mean"))


def load_state(df: DataFrame, feature: str = "load") -> DataFrame:
    """Level, energy, load factor, and points at or above the 90th percentile."""
    j = join_stats(df, ST, _p90=quantile(feature, 0.9))
    at = F.col(feature) >= F.col("_p90")
    return j.groupBy("state").agg(
        F.avg(feature).alias("average_load"), F.max(feature).alias("peak_load"), F.min(feature).alias("minimum_load"), F.sum(feature).alias("energy"),
        ratio(F.avg(feature), F.max(feature)).alias("load_factor"), count_where(at).alias("peak_points"), (share_where(at) * 100).alias("time_above_p90_pct"))


def shape(df: DataFrame, feature: str = "load") -> DataFrame:
    """Flatness, sharpness, valley depth, spread, shoulders, duck-curve severity and symmetry of the mean day."""
    x = F.col(feature)
    base = df.groupBy("state").agg(
        F.avg(x).alias("_avg"), ratio(F.stddev_samp(x), F.avg(x)).alias("curve_flatness"), ratio(F.max(x), F.avg(x)).alias("peak_sharpness"),
        ratio(F.max(x) - F.min(x), F.max(x)).alias("valley_depth"), (quantile(x, 0.95) - quantile(x, 0.05)).alias("spread_p95_p05"))
    h = df.groupBy("state", "hour").agg(F.avg(x).alias("m"))
    h = h.withColumn("step", F.col("m") - F.max("m").over(Window.partitionBy("state").orderBy("hour").rangeBetween(-1, -1)))
    hr = F.col("hour")
    hh = h.groupBy("state").agg(
        F.min(F.when(hr.between(11, 15), F.col("m"))).alias("_valley"), F.max(F.when(hr.between(18, 22), F.col("m"))).alias("_eve"),
        avg_where(hr.between(7, 9), "m").alias("_ms"), avg_where(hr.between(16, 18), "m").alias("_es"),
        avg_where(hr.between(7, 9), "step").alias("_mslope"), avg_where(hr.between(17, 19), "step").alias("_eslope"))
    j = base.join(hh, "state")
    sym = 1.0 - F.abs(F.col("_mslope") - F.col("_eslope")) / (F.abs("_mslope") + F.abs("_eslope") + 1e-6)
    return j.select("state", "curve_flatness", "peak_sharpness", "valley_depth", "spread_p95_p05",
                    ratio((F.col("_ms") + F.col("_es")) / 2.0, "_avg").alias("shoulder_strength"),
                    ratio(F.col("_eve") - F.col("_valley"), "_avg").alias("duck_severity"), sym.alias("symmetry"))


def ramps(df: DataFrame, ramp: str = "ramp") -> DataFrame:
    """Typical morning and evening ramp, extremes, spread, and the number of ramps above the 90th percentile of size."""
    j = join_stats(df, ST, _q=quantile(F.abs(ramp), 0.9))
    r, h = F.col(ramp), F.col("hour")
    return j.groupBy("state").agg(
        F.median(F.when(h.between(6, 10), r)).alias("morning_ramp"), F.median(F.when(h.between(16, 20), r)).alias("evening_ramp"),
        F.max(r).alias("max_ramp"), F.stddev_samp(r).alias("ramp_volatility"), F.min(r).alias("min_ramp"),
        count_where(F.abs(r) > F.col("_q")).alias("sustained_ramps"))


def peak_blocks(df: DataFrame, feature: str = "load") -> DataFrame:
    """Block and hour of each day's maximum (first among equals)."""
    return df.groupBy("state", "date").agg(top_by("block", feature, "block").alias("peak_block"), F.max(feature).alias("day_max"),
                                           F.min(feature).alias("day_min"), F.max("is_weekend").alias("is_weekend"))


def temporal(df: DataFrame, feature: str = "load") -> DataFrame:
    """How often the commonest peak block occurs, drift of the peak block, weekend level shift."""
    p = peak_blocks(df, feature)
    mode = p.groupBy("state", "peak_block").agg(F.count(F.lit(1)).alias("n")).groupBy("state").agg(F.max("n").alias("peak_block_frequency"))
    drift = p.groupBy("state").agg(F.stddev_samp("peak_block").alias("peak_drift"))
    shift = df.groupBy("state").agg((avg_where(F.col("is_weekend") == 1, feature) - avg_where(F.col("is_weekend") == 0, feature)).alias("weekend_shift"))
    return mode.join(drift, "state").join(shift, "state")


def stability(df: DataFrame, feature: str = "load") -> DataFrame:
    """Relative volatility, D-1 and D-7 rank persistence, p95-p05 band. Needs d1 and d7."""
    base = df.groupBy("state").agg(ratio(F.stddev_samp(feature), F.avg(feature)).alias("relative_volatility"),
                                   (quantile(feature, 0.95) - quantile(feature, 0.05)).alias("bandwidth"))
    rho = rank_corr_wide(df, ST, {"persistence_d1": ("d1", feature), "persistence_d7": ("d7", feature)})
    return base.join(rho, "state", "left")


WEATHER_COLS = ("temperature", "humidity", "precipitation", "cloud_cover", "direct_radiation", "wind_speed_10m")


def weather(df: DataFrame, feature: str = "load") -> DataFrame:
    """Rank correlation with every weather column and the heat index, humidity amplification, rain suppression."""
    pairs = {f"{c}_sensitivity": (feature, c) for c in WEATHER_COLS} | {"heat_stress": (feature, "heat_index")}
    rho = rank_corr_wide(df, ST, pairs)
    q = join_stats(df, ST, _q1=quantile("humidity", 0.25), _q3=quantile("humidity", 0.75))
    hum, rain = F.col("humidity"), F.col("precipitation")
    amp = q.groupBy("state").agg(ratio(avg_where(hum >= F.col("_q3"), feature), avg_where(hum <= F.col("_q1"), feature)).alias("humidity_amplification"),
                                 (avg_where(rain <= 0.1, feature) - avg_where(rain > 0.1, feature)).alias("rain_suppression_mw"))
    return rho.join(amp, "state")


def risk(df: DataFrame, feature: str = "load", capacity: float | None = None) -> DataFrame:
    """Tail shares and levels. ``capacity`` in MW adds the breach share. Needs ramp."""
    j = join_stats(df, ST, _p90=quantile(feature, 0.9), _p99=quantile(feature, 0.99))
    x = F.col(feature)
    breach = share_where(x > capacity) if capacity else F.lit(0.0)
    return j.groupBy("state").agg(
        share_where(x > F.col("_p90")).alias("peak_probability"), share_where(x > F.col("_p99")).alias("extreme_frequency"),
        quantile(F.abs("ramp"), 0.95).alias("ramp_stress"), F.max("_p99").alias("tail_p99"), breach.alias("capacity_breach"))


def composites(df: DataFrame, mape: Column | None = None) -> DataFrame:
    """Indices capped at 100 from relative volatility, extreme frequency, temperature slope and forecast error."""
    b = risk(df).select("state", "extreme_frequency", "ramp_stress")
    t = df.groupBy("state").agg(ratio(F.stddev_samp("load"), F.avg("load")).alias("relative_volatility"), slope("load", "temperature").alias("temp_slope"),
                                (F.avg(F.abs(F.col("load") - F.col("d7")) / F.nullif(F.col("load"), F.lit(0.0))) * 100).alias("mape"))
    j = b.join(t, "state")
    m = F.col("mape") if mape is None else mape
    cap = F.lit(100.0)
    return j.select(
        "state", F.least(cap, F.col("relative_volatility") * 100 + F.col("extreme_frequency") * 100).alias("grid_stress"),
        F.least(cap, F.abs("temp_slope") * 100).alias("weather_dependency"),
        F.least(cap, F.when(m > 0, F.greatest(F.lit(0.0), 100 - m)).otherwise(0.0)).alias("forecast_confidence"),
        F.least(cap, F.col("relative_volatility") * 50 + F.col("ramp_stress") * 2).alias("dispatch_difficulty"))


def distribution(df: DataFrame, feature: str = "load") -> DataFrame:
    """Mean, median, bias-corrected skewness and kurtosis, p05, p95 and the smallest modal value."""
    base = df.groupBy("state").agg(F.avg(feature).alias("mean"), F.median(feature).alias("median"), skew_sample(feature).alias("skewness"),
                                   kurt_sample(feature).alias("kurtosis"), quantile(feature, 0.95).alias("p95"), quantile(feature, 0.05).alias("p05"))
    cnt = df.where(F.col(feature).isNotNull()).groupBy("state", feature).agg(F.count(F.lit(1)).alias("n"))
    mode = cnt.groupBy("state").agg(top_by(feature, "n", feature).alias("mode"))
    return base.join(mode, "state")


def boxplot(df: DataFrame, feature: str = "load", by: str = "dow") -> DataFrame:
    """Five-number summary per group, and how far the highest group mean lies above the lowest."""
    g = df.groupBy("state", by).agg(F.min(feature).alias("low"), quantile(feature, 0.25).alias("q1"), F.median(feature).alias("median"),
                                    quantile(feature, 0.75).alias("q3"), F.max(feature).alias("high"), F.avg(feature).alias("mean"))
    w = Window.partitionBy("state")
    return g.withColumn("peak_gap_pct", pct_change(F.max("mean").over(w), F.min("mean").over(w)))


def duration_curve(df: DataFrame, feature: str = "load") -> DataFrame:
    """Load sorted downwards with the share of time it is reached."""
    w = Window.partitionBy("state").orderBy(F.desc(feature), "date", "block")
    n = F.count(F.lit(1)).over(Window.partitionBy("state"))
    return (df.where(F.col(feature).isNotNull()).withColumn("rank", F.row_number().over(w)).withColumn("n", n)
            .withColumn("pct_time", F.coalesce(ratio(F.col("rank") - 1, F.col("n") - 1), F.lit(0.0)) * 100))


def duration_p95(df: DataFrame, feature: str = "load") -> DataFrame:
    """Peak and the value at 5 % of the curve."""
    c = duration_curve(df, feature)
    at = F.col("rank") == F.floor(F.col("n") * 0.05) + 1
    return c.groupBy("state").agg(F.max(feature).alias("peak_load"), F.coalesce(F.max(F.when(at & (F.col("n") > 20), F.col(feature))), F.lit(0.0)).alias("p95_load"))


def ramp_rates(df: DataFrame) -> DataFrame:
    """Ramp in MW per hour: extremes and mean size."""
    r = F.col("ramp") / 0.25
    return df.groupBy("state").agg(F.max(r).alias("max_up_ramp"), F.min(r).alias("max_down_ramp"), F.avg(F.abs(r)).alias("avg_abs_ramp"))


def year_over_year(df: DataFrame, feature: str = "load") -> DataFrame:
    return df.groupBy("state", F.year("date").alias("year"), F.dayofyear("date").alias("day_of_year")).agg(F.avg(feature).alias("mean"))


def weather_dashboard(df: DataFrame) -> DataFrame:
    return df.groupBy("state").agg(F.max("temperature").alias("max_temp"), F.min("temperature").alias("min_temp"),
                                   F.sum("precipitation").alias("total_precip"), F.avg("humidity").alias("avg_humidity"))


# --- calendar effects and behaviour -------------------------------------------------------------------------------


def calendar_effect(df: DataFrame, feature: str = "load") -> DataFrame:
    """Weekday and weekend level (mean of block means), their gap, strongest season, weather correlation by day type."""
    prof = df.groupBy("state", "is_weekend", "block").agg(F.avg(feature).alias("m")).groupBy("state").agg(
        avg_where(F.col("is_weekend") == 0, "m").alias("weekday_avg"), avg_where(F.col("is_weekend") == 1, "m").alias("weekend_avg"))
    seas = (df.groupBy("state", "season", "is_weekend").agg(F.avg(feature).alias("m")).groupBy("state", "season").agg(F.avg("m").alias("m"))
            .groupBy("state").agg(F.max_by("season", F.struct("m", "season")).alias("strongest_season")))
    parts = {}
    for c in ("temperature", "humidity", "precipitation"):
        for tag, flag in (("weekday", 0), ("weekend", 1)):
            parts[f"{c}_{tag}"] = F.when(F.col("is_weekend") == flag, F.col(c))
    rho = rank_corr_wide(df.withColumns(parts), ST, {p: (feature, p) for p in parts})
    return prof.withColumn("weekend_effect_pct", pct_change("weekend_avg", "weekday_avg")).join(seas, "state").join(rho, "state", "left")


def season_table(df: DataFrame, feature: str = "load") -> DataFrame:
    return df.groupBy("state", "season", "is_weekend").agg(F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("std"))


def behaviour_blocks(df: DataFrame, feature: str = "load") -> DataFrame:
    """Per block: level, spread, peak, peak ratio, weekend delta, and the mean at low, medium and high temperature."""
    from quarterhour.operators.select import tertiles
    base = df.groupBy("state", "block").agg(
        F.avg(feature).alias("avg_load"), F.stddev_samp(feature).alias("std_load"), F.max(feature).alias("peak_load"),
        F.coalesce(avg_where(F.col("is_weekend") == 1, feature) - avg_where(F.col("is_weekend") == 0, feature), F.lit(0.0)).alias("weekend_delta"))
    t = tertiles(df, "temperature").groupBy("state", "block").agg(*[avg_where(F.col("tertile") == i + 1, feature).alias(n)
                                                                    for i, n in enumerate(("temp_low", "temp_medium", "temp_high"))])
    return base.withColumn("peak_ratio", F.col("peak_load") / (F.col("avg_load") + 1e-6)).join(t, ["state", "block"], "left")


def behaviour(df: DataFrame, feature: str = "load") -> DataFrame:
    """Nine behaviour KPIs. Evening means hours 18 to 22."""
    pk = peak_blocks(df, feature).groupBy("state").agg(share_where(F.floor((F.col("peak_block") - 1) / 4).between(18, 22)).alias("peak_evening_probability"))
    b = behaviour_blocks(df, feature).groupBy("state").agg(
        F.avg("std_load").alias("curve_flatness"), F.avg(F.abs("weekend_delta")).alias("weekend_flattening"),
        F.avg(F.coalesce("std_load", F.lit(0.0))).alias("block_volatility"))
    r = df.groupBy("state").agg(
        F.avg(F.abs("ramp")).alias("average_ramp"),
        (avg_where(F.col("is_holiday") == 1, feature) / (avg_where(F.col("is_holiday") == 0, feature) + 1e-6)).alias("holiday_suppression"),
        F.avg(F.abs("baseline_dev")).alias("daily_curve_deviation"), F.avg("dev_score").alias("peak_risk"))
    rho = rank_corr_wide(df, ST, {"cooling_sensitivity": (feature, "temperature")})
    return pk.join(b, "state").join(r, "state").join(rho, "state", "left")


def tab_time(df: DataFrame, feature: str = "load") -> DataFrame:
    x, h = F.col(feature), F.col("hour")
    p = peak_blocks(df, feature).groupBy("state").agg(
        (share_where(F.floor((F.col("peak_block") - 1) / 4).between(18, 22)) * 100).alias("peak_evening_pct"), F.avg("day_max").alias("peak_load_daily"),
        F.coalesce(F.stddev_samp("peak_block"), F.lit(0.0)).alias("peak_timing_stability"),
        (F.avg(F.col("day_max") - F.col("day_min")) / (F.avg("day_max") + 1e-6)).alias("valley_depth"))
    a = df.groupBy("state").agg(
        F.avg(F.when(h.between(7, 10), F.abs("ramp"))).alias("morning_ramp"), F.avg(F.when(h.between(18, 22), F.abs("ramp"))).alias("evening_ramp"),
        F.avg(F.when(h.between(1, 5), x)).alias("base_load_night"), F.avg(F.abs("ramp")).alias("intraday_volatility"))
    f = df.groupBy("state", "date").agg(F.stddev_samp(x).alias("s")).groupBy("state").agg(F.avg("s").alias("curve_flatness"))
    m = block_profile(df, feature).groupBy("state").agg(F.avg("mean").alias("avg_load_per_block"))
    return p.join(a, "state").join(f, "state").join(m, "state")


def tab_calendar(df: DataFrame, holidays: DataFrame, feature: str = "load") -> DataFrame:
    """Weekend, holiday, pre-holiday, bridge and long-weekend effects on daily means; days until recovery to 95 %."""
    d = day_context(df.groupBy("state", "date").agg(F.avg(feature).alias("v"), F.max("is_weekend").alias("is_weekend")), holidays)
    d = holiday_flag(d, holidays)
    one = lambda c: F.col(c) == 1
    a = d.groupBy("state").agg(
        avg_where(one("is_weekend"), "v").alias("we"), avg_where(~one("is_weekend"), "v").alias("wd"), avg_where(one("is_holiday"), "v").alias("ho"),
        avg_where(~one("is_holiday"), "v").alias("nh"), avg_where(one("days_to_holiday") & ~one("is_holiday"), "v").alias("pre"),
        avg_where(one("bridge_day"), "v").alias("br"), avg_where(one("long_weekend"), "v").alias("lw"))
    h = F.col("hour")
    m = df.groupBy("state").agg(*[avg_where((F.col("is_holiday") == f) & h.between(*hrs), feature).alias(n)
                                  for n, f, hrs in (("hm", 1, (7, 10)), ("nm", 0, (7, 10)), ("he", 1, (18, 22)), ("ne", 0, (18, 22)))])
    pk = peak_blocks(df, feature).groupBy("state").agg((avg_where(one("is_weekend"), "peak_block") - avg_where(~one("is_weekend"), "peak_block")).alias("peak_shift"))
    lim = d.join(a.select("state", "nh"), "state")
    # next day at or above 95 % of the normal level: running minimum over the days that follow, newest first
    back = Window.partitionBy("state").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)
    lim = lim.withColumn("_rec", F.min(F.when(F.col("v") >= 0.95 * F.col("nh"), F.col("date"))).over(back))
    rec = lim.where(one("is_holiday")).groupBy("state").agg(F.avg(F.datediff("_rec", "date")).alias("recovery_days"))
    j = a.join(m, "state").join(pk, "state").join(rec, "state", "left")
    return j.select(
        "state", pct_change("we", "wd").alias("weekend_change_pct"), ratio("ho", "nh").alias("holiday_suppression"), pct_change("pre", "nh").alias("pre_holiday_pct"),
        F.coalesce("recovery_days", F.lit(0.0)).alias("recovery_days"), pct_change("br", "nh").alias("bridge_pct"), pct_change("lw", "we").alias("long_weekend_pct"),
        "peak_shift", pct_change("hm", "nm").alias("holiday_morning_pct"), pct_change("he", "ne").alias("holiday_evening_pct"))


def tab_weather(df: DataFrame, feature: str = "load") -> DataFrame:
    j = join_stats(df, ST, _q8=quantile("temperature", 0.8), _q5=quantile("temperature", 0.5))
    x, t, hum, rain, h = F.col(feature), F.col("temperature"), F.col("humidity"), F.col("rain_proxy"), F.col("hour")
    a = j.groupBy("state").agg(
        slope(x, t).alias("temp_sensitivity"), avg_where(F.col("cooling_degree") > 0, x).alias("cool"), avg_where(F.col("cooling_degree") == 0, x).alias("heat"),
        ratio(avg_where(hum >= 75, x), avg_where(hum < 75, x)).alias("humidity_amplification"),
        *[avg_where((rain == r) & h.between(*hrs), x).alias(n) for n, r, hrs in (("rd", 1, (9, 17)), ("nd", 0, (9, 17)), ("re", 1, (18, 22)), ("ne", 0, (18, 22)))],
        F.max(F.when(t >= F.col("_q8"), x)).alias("hot"), F.max(F.when(t <= F.col("_q5"), x)).alias("normal"))
    rho = rank_corr_wide(df, ST, {"heat_stress": (feature, "heat_index")})
    el = rank_corr_wide(df, ["state", "season"], {"r": ("temperature", feature)}).groupBy("state").agg(F.avg(F.abs("r")).alias("seasonal_elasticity"))
    return a.join(rho, "state", "left").join(el, "state", "left").select(
        "state", "temp_sensitivity", pct_change("cool", "heat").alias("cooling_pct"), pct_change("heat", "cool").alias("heating_pct"), "humidity_amplification",
        pct_change("rd", "nd").alias("rain_day_pct"), pct_change("re", "ne").alias("rain_evening_pct"), "heat_stress",
        pct_change("hot", "normal").alias("peak_expansion_pct"), "seasonal_elasticity")


def tab_memory(df: DataFrame, feature: str = "load") -> DataFrame:
    rho = rank_corr_wide(df, ST, {"same_block_persistence": ("d1", feature), "weekly_recurrence": ("d7", feature), "rolling_dependency": ("roll7_block", feature)})
    a = df.groupBy("state").agg((F.stddev_samp(feature) / (F.avg(F.abs("ramp")) + 1e-6)).alias("load_inertia"),
                                F.stddev_samp(F.when(F.col("hour").between(1, 5), F.col(feature))).alias("base_load_stability"))
    w = df.groupBy("state", "dow").agg(F.stddev_samp(feature).alias("s")).groupBy("state").agg(F.avg("s").alias("weekly_reliability"))
    return rho.join(a, "state").join(w, "state")


def tab_trend(df: DataFrame, feature: str = "load") -> DataFrame:
    """Changes of the daily mean day on day and week on week, growth of the peak, streaks, acceleration."""
    d = daily(df, feature).withColumn("i", F.row_number().over(day_order()))
    w = day_order()
    d = d.withColumns({"dod": pct_change("avg", F.lag("avg", 1).over(w)), "wow": pct_change("avg", F.lag("avg", 7).over(w)),
                       "roll": F.avg("avg").over(w.rowsBetween(-6, 0))})
    d = d.withColumn("acc", F.abs(F.col("dod") - F.lag("dod").over(w)))
    rising = F.coalesce(F.col("dod") > 0, F.lit(False))
    runs = run_ids(d, rising, ST, "date").groupBy("state", "run_id").agg(count_where(rising).alias("n")).groupBy("state").agg(F.avg("n").alias("trend_persistence_days"))
    d = join_stats(d, ST, _s=F.stddev_samp("dod"))
    a = d.groupBy("state").agg(
        F.avg("dod").alias("dod_change_pct"), F.avg("wow").alias("wow_change_pct"), slope("max", "i").alias("peak_growth"), F.avg("acc").alias("acceleration"),
        share_where(F.abs("dod") > 2 * F.col("_s")).alias("regime_shift"), (1.0 / (1.0 + F.max("_s"))).alias("momentum_stability"))
    rho = rank_corr_wide(d, ST, {"trend_strength": ("i", "roll")})
    return a.join(runs, "state").join(rho, "state", "left")


def tab_interaction(df: DataFrame, feature: str = "load") -> DataFrame:
    j = join_stats(df, ST, _q8=quantile("temperature", 0.8))
    x = F.col(feature)
    hot = F.coalesce(F.col("temperature") >= F.col("_q8"), F.lit(False))
    a = j.groupBy("state").agg(
        ratio(avg_where(hot & (F.col("is_evening_peak") == 1), x), F.avg(x)).alias("peak_temp_amplification"),
        ratio(avg_where(hot & (F.col("is_weekend") == 1), x), avg_where(hot & (F.col("is_weekend") == 0), x)).alias("weekend_heat"),
        ratio(avg_where(hot & (F.col("is_holiday") == 1), x), avg_where(hot & (F.col("is_holiday") == 0), x)).alias("holiday_heat"),
        share_where(hot & (F.col("is_evening_peak") == 1)).alias("weather_peak_coincidence"))
    m = df.withColumn("_mw", F.col("d1") * F.col("temperature"))
    rho = rank_corr_wide(m, ST, {"memory_weather": ("_mw", feature), "_a": ("temp_x_peak", feature), "_b": ("weather_x_load", feature)})
    return a.join(rho, "state", "left").withColumn("interaction_strength", (F.abs("_a") + F.abs("_b")) / 2.0).drop("_a", "_b")


def tab_baseline(df: DataFrame, feature: str = "load") -> DataFrame:
    prof = block_profile(df, feature).groupBy("state").agg(top_by("block", "mean", "block").alias("_pb"), F.max("mean").alias("_pm"), F.avg("mean").alias("_am"))
    p = peak_blocks(df, feature).join(prof, "state").groupBy("state").agg(
        F.avg(F.abs(F.col("peak_block") - F.col("_pb"))).alias("peak_timing_offset"), F.avg(F.col("day_max") - F.col("_pm")).alias("baseline_peak_deviation"))
    d = daily(df, feature).groupBy("state").agg(F.avg("avg").alias("_d")).join(prof, "state").select("state", pct_change("_d", "_am").alias("daily_energy_deviation_pct"))
    s = df.groupBy("state", "season").agg(F.avg(feature).alias("_sp"), F.count(feature).alias("_n")).groupBy("state").agg(
        F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_sp")).alias("_s1"), F.sum(F.col("_n") * F.col("_sp") * F.col("_sp")).alias("_s2"))
    a = df.groupBy("state").agg((F.avg(F.abs("baseline_dev")) / (F.avg(feature) + 1e-6) * 100).alias("baseline_error_pct"),
                                F.stddev_samp("baseline_dev").alias("baseline_stability")).join(s, "state")
    drift = F.sqrt(F.greatest(F.lit(0.0), (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("_n")) / (F.col("_n") - 1)))
    a = a.withColumn("seasonal_drift", drift).drop("_n", "_s1", "_s2")
    return a.join(p, "state").join(d, "state")


def tab_stability(df: DataFrame, feature: str = "load") -> DataFrame:
    j = volatility_flag(join_stats(rolling_spread(df), ST, _p99=quantile(feature, 0.99)))
    a = j.groupBy("state").agg(
        F.avg("block_std").alias("peak_volatility"), F.avg("dev_score").alias("block_risk"), quantile(F.abs("ramp"), 0.95).alias("ramp_stress"),
        F.avg(F.abs("baseline_dev")).alias("curve_distortion"), share_where(F.col(feature) > F.col("_p99")).alias("extreme_frequency"),
        F.avg("peak_volatility").alias("dispatch_risk"), F.avg("load_roll_7d_std").alias("load_uncertainty"))
    d = daily(df, feature).withColumn("c", pct_change("avg", F.lag("avg").over(day_order())))
    d = join_stats(d, ST, _s=F.stddev_samp("c"))
    return a.join(d.groupBy("state").agg(count_where(F.abs("c") > 2 * F.col("_s")).alias("anomaly_days")), "state")


def tab_executive(df: DataFrame, feature: str = "load") -> DataFrame:
    x = F.col(feature)
    a = volatility_flag(df).groupBy("state").agg(
        quantile(x, 0.9).alias("peak_range_low"), quantile(x, 0.99).alias("peak_range_high"), (1.0 / (1.0 + F.stddev_samp(x))).alias("system_stability"),
        (1.0 / (1.0 + F.avg(F.abs("baseline_dev")))).alias("forecast_readiness"), F.avg("peak_volatility").alias("operational_risk"),
        pct_change(avg_where(F.col("is_holiday") == 1, x), avg_where(F.col("is_holiday") == 0, x)).alias("holiday_impact_pct"))
    rho = rank_corr_wide(df, ST, {"weather_sensitivity": ("temperature", feature)})
    return a.join(rho, "state", "left").join(monthly_growth(df, feature), "state", "left")


def monthly_growth(df: DataFrame, feature: str = "load") -> DataFrame:
    """Slope of the monthly means per month."""
    m = df.groupBy("state", F.trunc("date", "month").alias("m")).agg(F.avg(feature).alias("v"))
    m = m.withColumn("i", F.row_number().over(Window.partitionBy("state").orderBy("m")))
    return m.groupBy("state").agg(F.coalesce(slope("v", "i"), F.lit(0.0)).alias("growth_rate"))
