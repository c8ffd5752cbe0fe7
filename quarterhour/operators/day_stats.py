"""Per-day statistics, day-type metrics and diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import pct_change, ratio
from quarterhour.functions.stats import avg_where, count_where, quantile, rank_corr, share_where, sum_where, top_by, kurt_sample
from quarterhour.operators.calendar import daypart
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import day_lag, run_ids

DAY = ["state", "date"]
ST = ["state"]

# Day windows as (name, first block, last block); a window that starts after it ends wraps midnight.
WEATHER_WINDOWS = [("Morning", 25, 40), ("Midday", 41, 68), ("Evening", 69, 92), ("Night", 93, 24)]
DELTA_WINDOWS = [("morning_ramp", 24, 43), ("midday_plateau", 40, 56), ("evening_peak", 68, 83), ("night_valley", 88, 16)]
TOD_GROUPS = [("Night", 93, 24), ("Morning Peak", 25, 40), ("Day", 41, 68), ("Evening Peak", 69, 92)]
RESIDUAL_WINDOWS = [("Morning", 21, 40), ("Midday", 41, 68), ("Evening", 69, 92), ("Night", 93, 20)]


def in_window(block: Column | str, lo: int, hi: int) -> Column:
    b = F.col(block) if isinstance(block, str) else block
    return b.between(lo, hi) if lo <= hi else ((b >= lo) | (b <= hi))


def day_type_metrics(df: DataFrame, feature: str = "load") -> DataFrame:
    """Weekday and weekend daily totals, their gap, rain response, 2-sigma days, completeness of the last dates."""
    d = df.groupBy(*DAY).agg(F.sum(feature).alias("total"), F.count("block").alias("n"), F.max("is_weekend").alias("we"))
    d = d.withColumn("_r", F.dense_rank().over(Window.partitionBy("state").orderBy(F.desc("date"))))
    d = join_stats(d, ST, _m=F.avg("total"), _s=F.stddev_samp("total"))
    a = d.groupBy("state").agg(
        avg_where(F.col("we") == 0, "total").alias("weekday_avg"), avg_where(F.col("we") == 1, "total").alias("weekend_avg"),
        count_where(F.abs(F.col("total") - F.col("_m")) > 2 * F.col("_s")).alias("baseline_outlier_days"),
        (ratio(sum_where(F.col("_r") <= 30, "n"), count_where(F.col("_r") <= 30) * 96) * 100).alias("completeness_pct"))
    dry, wet = avg_where(F.col("precipitation") == 0, feature), avg_where(F.col("precipitation") > 0, feature)
    r = df.groupBy("state").agg((ratio(dry - wet, F.greatest(dry, F.lit(1e-6))) * 100).alias("precip_response_pct"))
    return a.join(r, "state").withColumn("weekend_change_pct", ratio(F.col("weekday_avg") - F.col("weekend_avg"), "weekday_avg") * 100)


def baseline_quality(df: DataFrame, date: str, window: int = 7, feature: str = "load") -> DataFrame:
    """Score of the days before a date as its baseline: amount, completeness, stability, weather similarity."""
    d = F.lit(date).cast("date")
    base = df.where((F.col("date") < d) & (F.col("date") >= F.date_sub(d, window)))
    day = base.groupBy(*DAY).agg(F.sum(feature).alias("total"), F.count("block").alias("n"))
    s = day.groupBy("state").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("blocks"), F.coalesce(F.stddev_samp("total"), F.lit(0.0)).alias("std"), F.avg("total").alias("mean"))
    w = ("temperature", "humidity", "precipitation")
    bw = base.groupBy("state").agg(*[F.avg(c).alias(f"b_{c}") for c in w])
    aw = df.where(F.col("date") == d).groupBy("state").agg(*[F.avg(c).alias(f"a_{c}") for c in w])
    j = s.join(bw, "state").join(aw, "state")
    diff = sum((F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / (F.abs(f"b_{c}") + 1) for c in w), F.lit(0.0)) / 3.0
    j = j.withColumns({
        "completeness_pct": F.col("blocks") / (F.col("days") * 96.0) * 100, "stability": F.greatest(F.lit(0.0), 100 - F.col("std") / F.greatest("mean", F.lit(1e-6)) * 100),
        "weather_similarity": F.greatest(F.lit(0.0), 100 - diff * 100), "_w": F.least(F.lit(1.0), F.col("days") / 7.0) * 100})
    score = 0.4 * F.col("_w") + 0.25 * F.col("completeness_pct") + 0.25 * F.col("stability") + 0.1 * F.col("weather_similarity")
    return j.select("state", score.alias("score"), "days", "completeness_pct", "std", "stability", "weather_similarity")


def intraday_weather(df: DataFrame) -> DataFrame:
    """Weather of each block against its normal (mean of the days before) and against the day before."""
    d1 = {c: day_lag(c, 1) for c in ("temperature", "humidity", "precipitation")}
    return df.select(*DAY, "block", "temperature", "n_temp", (F.col("temperature") - F.col("n_temp")).alias("temp_delta"),
                     (F.col("humidity") - F.col("n_hum")).alias("hum_delta"), (F.col("precipitation") - F.col("n_rain")).alias("rain_delta"),
                     *[(F.col(c) - lag).alias(f"{c}_dod") for c, lag in d1.items()])


def weather_windows(df: DataFrame) -> DataFrame:
    """Per day and window: temperature and humidity with their deltas, rain total and the stress status."""
    d = df.withColumn("window", daypart("block", WEATHER_WINDOWS))
    a = d.groupBy(*DAY, "window").agg(
        F.avg("temperature").alias("temp_avg"), (F.avg("temperature") - F.avg("n_temp")).alias("temp_delta"), F.avg("humidity").alias("hum_avg"),
        (F.avg("humidity") - F.avg("n_hum")).alias("hum_delta"), F.sum("precipitation").alias("precip_total"))
    return a.withColumn("status", F.when(F.col("temp_delta") > 3, "Heat Stress").when(F.col("temp_delta") < -3, "Cold Stress").otherwise("Normal"))


def rain_and_change(df: DataFrame) -> DataFrame:
    """Rain total, intensity and hours of each day, and max / min temperature and humidity against the day before."""
    a = df.groupBy(*DAY).agg(
        F.sum("precipitation").alias("rain_mm"), F.max("precipitation").alias("max_intensity"), (count_where(F.col("precipitation") > 0) * 0.25).alias("rain_hours"),
        F.max("temperature").alias("max_temp"), F.min("temperature").alias("min_temp"), F.avg("humidity").alias("avg_humidity"))
    w = ("state",)
    return a.withColumns({f"{c}_change": F.col(c) - day_lag(c, 1, w) for c in ("max_temp", "min_temp", "avg_humidity")})


def window_deltas(df: DataFrame, actual: str = "load", baseline: str = "baseline") -> DataFrame:
    """Sum of actual minus baseline per day window; windows may overlap and wrap."""
    e = F.col(actual) - F.col(baseline)
    return df.groupBy(*DAY).agg(*[F.coalesce(sum_where(in_window("block", lo, hi), e), F.lit(0.0)).alias(f"{n}_delta_mw") for n, lo, hi in DELTA_WINDOWS])


def daily_change(df: DataFrame, min_common: int = 72, feature: str = "load") -> DataFrame:
    """Change of the daily mean over the blocks observed on both days."""
    d = df.withColumn(feature, F.when(F.col(feature) > 0, F.col(feature))).withColumn("prev", day_lag(feature, 1))
    both = F.col(feature).isNotNull() & F.col("prev").isNotNull()
    a = d.groupBy(*DAY).agg(count_where(both).alias("blocks_compared"), avg_where(both, feature).alias("c"), avg_where(both, "prev").alias("p"))
    return a.where((F.col("blocks_compared") >= min_common) & (F.col("p") > 0)).select(*DAY, pct_change("c", "p").alias("value"), "blocks_compared")


def block_change(df: DataFrame, date: str, other: str, feature: str = "load") -> DataFrame:
    """Change in percent per block between two dates."""
    v = F.when(F.col(feature) > 0, F.col(feature))
    a = df.where(F.col("date").isin(F.lit(date).cast("date"), F.lit(other).cast("date"))).groupBy("state", "block").agg(
        F.max(F.when(F.col("date") == F.lit(date).cast("date"), v)).alias("a"), F.max(F.when(F.col("date") == F.lit(other).cast("date"), v)).alias("b"))
    return a.select("state", "block", pct_change("a", "b").alias("change_pct"))


def day_profile(df: DataFrame, feature: str = "load") -> DataFrame:
    """Peak, valley, energy, load factor, ramps between adjacent blocks, deviation from the day before, night base,
    plateau, peak / valley ratio and duck-curve severity of every day."""
    day = Window.partitionBy(*DAY).orderBy("block")
    x, b = F.col(feature), F.col("block")
    d = df.withColumn("_ramp", x - F.max(feature).over(day.rangeBetween(-1, -1))).withColumn("_dev", x - day_lag(feature, 1))
    h = d.groupBy(*DAY, "hour").agg(F.avg(x).alias("m")).groupBy(*DAY).agg(
        avg_where(F.col("hour") < 6, "m").alias("night_base"), (F.max(F.when(F.col("hour") == 10, F.col("m"))) - F.max(F.when(F.col("hour") == 6, F.col("m")))).alias("morning_ramp"),
        avg_where(F.col("hour").between(12, 16), "m").alias("afternoon_plateau"), avg_where(F.col("hour").between(18, 20), "m").alias("evening_peak"))
    a = d.groupBy(*DAY).agg(
        F.max(x).alias("peak"), F.min(F.when(x > 0, x)).alias("valley"), top_by("block", feature, "block").alias("peak_block"), (F.sum(x) * 0.25).alias("energy_mwh"),
        F.avg(x).alias("avg"), (ratio(F.avg(x), F.max(x)) * 100).alias("load_factor"), F.count(x).alias("valid_blocks"), F.max("_ramp").alias("max_ramp_up"),
        F.min("_ramp").alias("max_ramp_down"), F.max(F.abs("_dev")).alias("max_deviation"), F.avg(F.abs("_dev")).alias("avg_deviation"),
        ratio(F.max(x), F.min(F.when(x > 0, x))).alias("pv_ratio"),
        ratio(F.min(F.when(b.between(40, 56) & (x > 0), x)), F.max(F.when(b.between(44, 56), x))).alias("duck_severity"))
    return a.join(h, DAY).withColumn("duck_flag", F.coalesce(F.col("duck_severity") < 0.65, F.lit(False)))


def tod_groups(df: DataFrame, feature: str = "load") -> DataFrame:
    """Average, peak and energy per time-of-day group of each day."""
    d = df.withColumn("tod", daypart("block", TOD_GROUPS))
    return d.groupBy(*DAY, "tod").agg(F.avg(feature).alias("avg_load"), F.max(feature).alias("peak_mw"), (F.sum(feature) * 0.25).alias("energy_mwh"))


def tod_flags(df: DataFrame, feature: str = "load") -> DataFrame:
    """Blocks more than two (population) sigma away from the mean of their time-of-day group on that day."""
    d = df.where(F.col(feature) > 0).withColumn("tod", daypart("block", TOD_GROUPS))
    d = join_stats(d, [*DAY, "tod"], _m=F.avg(feature), _s=F.stddev_pop(feature))
    return d.where((F.col("_s") > 0) & (F.abs(F.col(feature) - F.col("_m")) > 2 * F.col("_s"))).select(*DAY, "block", "tod", feature)


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median, interquartile range and kurtosis of several columns, long form."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select("state", F.explode(items).alias("p")).select("state", "p.*").where("v is not null")
    return long.groupBy("state", "column").agg(F.median("v").alias("median"), (quantile("v", 0.75) - quantile("v", 0.25)).alias("iqr"), kurt_sample("v").alias("kurtosis"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman matrix in long form; each pair is ranked once and mirrored."""
    pairs = {f"{a}|{b}": (a, b) for i, a in enumerate(columns) for b in columns[i:]}
    r = rank_corr(df, ST, pairs)
    r = r.select("state", F.split("pair", "[|]").alias("p"), "rho").select("state", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "rho")
    return r.unionByName(r.where("a <> b").select("state", F.col("b").alias("a"), F.col("a").alias("b"), "rho"))


def strongest_pair(matrix: DataFrame) -> DataFrame:
    m = matrix.where("a < b")
    best = F.max_by(F.struct("a", "b", "rho"), F.struct(F.round(F.abs("rho"), 9), "a", "b")).alias("x")
    return m.groupBy("state").agg(best).select("state", "x.*")


def weather_regime_day(df: DataFrame) -> DataFrame:
    """Comfort score, compound multipliers, regime class, weather MW and solar-ramp risk of every day."""
    b = F.col("block")
    sol = F.when(b.between(32, 48), F.col("direct_radiation"))
    d = df.groupBy(*DAY).agg(F.avg("temperature").alias("t"), F.max("temperature").alias("tx"), F.avg("humidity").alias("h"), F.sum("precipitation").alias("p"),
                             F.avg("cloud_cover").alias("c"), F.avg("wind_speed_10m").alias("w"), F.max(sol).alias("smax"), F.min(sol).alias("smin"))
    t, tx, h, p, c, w = (F.col(x) for x in ("t", "tx", "h", "p", "c", "w"))
    zero = F.lit(0.0)
    comfort = (100.0 - F.when(tx > 35, (tx - 35) * 6).when(tx > 30, (tx - 30) * 3).otherwise(0.0) - F.when(h > 70, (h - 70) * 0.5).otherwise(0.0)
               - F.when(p > 5, F.least(F.lit(15.0), p * 1.5)).otherwise(0.0))
    regime = (F.when(tx > 42, "Extreme Heat").when((p > 10) & (c > 70), "Rainy").when((tx > 38) & (h < 35), "Hot & Dry").when((tx > 35) & (h > 65), "Hot & Humid")
              .when((tx < 28) & (c > 60), "Cool & Cloudy").otherwise("Normal"))
    mult = (F.when((tx > 35) & (h > 65), 1.25).otherwise(1.0) * F.when((tx > 38) & (h < 30) & (w < 10), 1.15).otherwise(1.0) * F.when((p > 5) & (c > 70), 0.85).otherwise(1.0))
    # fixed values: MW per unit above the threshold of each variable
    mw = (32.0 * F.greatest(zero, t - 28) + 7.0 * F.greatest(zero, h - 60) - 3.0 * c - 18.0 * F.least(F.greatest(zero, p), F.lit(20.0))
          - 1.8 * F.greatest(zero, w - 20))
    drop = ratio(F.col("smax") - F.col("smin"), "smax") * 100
    return d.select(*DAY, F.greatest(zero, F.least(F.lit(100.0), comfort)).alias("comfort"), regime.alias("regime"), mult.alias("multiplier"), (mw * mult).alias("net_mw"),
                    F.when(F.col("smax") > 50, drop).alias("solar_drop_pct"), F.coalesce((F.col("smax") > 50) & (drop > 30), F.lit(False)).alias("solar_risk"))


def residual_diagnostics(df: DataFrame, actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """Per day: level, spread and outlier share of the residuals, longest same-sign run, worst window, letter grade."""
    d = df.withColumn("r", F.col(actual) - F.col(forecast))
    d = join_stats(d, DAY, _s=F.stddev_pop("r"))
    sign = F.when(F.col("r") > 0, 1).otherwise(-1)
    runs = run_ids(d, sign, DAY, "block").groupBy(*DAY, "run_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*DAY).agg(F.max("n").alias("longest_run"))
    win = d.withColumn("w", daypart("block", RESIDUAL_WINDOWS)).groupBy(*DAY, "w").agg(F.avg(F.abs("r")).alias("m")).groupBy(*DAY).agg(F.max_by("w", F.struct("m", "w")).alias("worst_window"))
    a = d.groupBy(*DAY).agg(F.avg("r").alias("mean"), F.median("r").alias("median"), F.stddev_pop("r").alias("std"), F.avg(F.abs("r")).alias("mae"),
                            (share_where(F.abs("r") > 2 * F.col("_s")) * 100).alias("outlier_pct"), (F.avg(F.abs(ratio("r", actual))) * 100).alias("mape"))
    m = F.col("mape")
    grade = F.when(m < 1.5, "A").when(m < 3, "B").when(m < 5, "C").otherwise("D")
    bias = F.when(F.col("mean") > 10, "Under-forecasting").when(F.col("mean") < -10, "Over-forecasting").otherwise("Well-centered")
    return a.join(runs, DAY).join(win, DAY).withColumn("systematic", F.col("longest_run") >= 8).withColumn("grade", grade).withColumn("bias", bias)


def distinct_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ST, approximate: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(*keys).agg(*[fn(c).alias(f"n_{c}") for c in columns])


def interaction_pairs(df: DataFrame) -> DataFrame:
    """Inputs of the same-day interaction correlations."""
    return df.withColumns({"_hi": F.col("temperature") + 0.33 * F.col("humidity") - 4.0, "_rt": F.col("precipitation") * F.col("temperature"),
                           "_wt": F.col("temperature") * F.col("is_weekend")})


def max_ramp(df: DataFrame, feature: str = "load") -> DataFrame:
    day = Window.partitionBy(*DAY).orderBy("block")
    d = df.withColumn("_r", F.abs(F.col(feature) - F.max(feature).over(day.rangeBetween(-1, -1))))
    return d.groupBy(*DAY).agg(F.coalesce(F.max("_r"), F.lit(0.0)).alias("max_ramp"), top_by("block", "_r", "block").alias("max_ramp_block"))


def last_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of each state's last n dates on record. The dates are ranked on the daily list, not on the rows."""
    d = df.select(*DAY).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date"))))
    return df.join(d.where(F.col("_r") <= n).drop("_r"), DAY, "left_semi")
