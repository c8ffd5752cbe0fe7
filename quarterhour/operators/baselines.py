"""Baseline forecasts. All target dates are computed at once; nothing after a target's origin is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import rotated
from quarterhour.functions.numbers import nonneg, ratio
from quarterhour.functions.stats import count_where, quantile
from quarterhour.operators.calendar import holiday_flag
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import blocks_of_days, day_lag, days_ago

SB = ("state", "block")
DAY = ["state", "date"]


#: Days up to the origin among which a baseline looks for days like the target.
LOOKBACK = 14


def seasonal_naive(grid: DataFrame, season_days: int = 7, out: str = "forecast") -> DataFrame:
    """The same block ``season_days`` earlier."""
    return grid.withColumn(out, day_lag("load", season_days))


def off_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    d = holiday_flag(days, holidays, "_h")
    return d.withColumn("off", (F.weekday("date") >= 5) | (F.col("_h") == 1)).drop("_h")


def recent_days(grid: DataFrame, holidays: DataFrame, horizons: Sequence[int] = (1,), k: int = 3, lookback: int = LOOKBACK) -> DataFrame:
    """For several horizons: mean of the k latest same-type days among the ``lookback`` days up to the origin, else of the
    plain last k days. Columns state, date, block and ``h<horizon>``.

    The day choice is made on the daily list (one row per day) for all horizons at once; a chosen day is then expanded
    into the (target, horizon) pairs that use it, so block rows are shuffled once by day and once for the final mean.
    """
    day = off_days(grid.groupBy(*DAY).agg(F.count("load").alias("_n")), holidays)
    offers = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(lag).alias("lag")) for h in horizons for lag in range(h, h + lookback)])
    pairs = day.where(F.col("_n") > 0).select("state", F.col("date").alias("cand"), F.col("off").alias("c_off"), F.explode(offers).alias("o")).select(
        "state", "cand", "c_off", F.col("o.h").alias("_h"), F.col("o.lag").alias("_lag"), F.date_add("cand", F.col("o.lag")).alias("date"))
    pairs = pairs.join(day.select("state", "date", "off"), DAY)
    w = Window.partitionBy(*DAY, "_h")
    same = F.col("c_off") == F.col("off")
    rk = F.sum(F.when(same, 1).otherwise(0)).over(w.orderBy("_lag").rowsBetween(Window.unboundedPreceding, 0))
    pairs = pairs.withColumn("_same", same).withColumn("_rk", rk)
    hit = F.col("_same") & (F.col("_rk") <= k)
    enough = F.sum(F.when(hit, 1).otherwise(0)).over(w) >= k
    plain = F.col("_lag") <= F.col("_h") + k - 1
    chosen = pairs.withColumn("_use", F.when(enough, hit).otherwise(plain)).where("_use").select("state", "cand", "date", "_h")
    vals = grid.where(F.col("load").isNotNull()).select("state", F.col("date").alias("cand"), "block", "load")
    return chosen.join(vals, ["state", "cand"]).groupBy("state", "date", "block").agg(*[F.avg(F.when(F.col("_h") == h, F.col("load"))).alias(f"h{h}") for h in horizons])


def recent_day(grid: DataFrame, holidays: DataFrame, horizon: int = 1, k: int = 3, lookback: int = LOOKBACK) -> DataFrame:
    """``recent_days`` for one horizon, as column ``forecast``."""
    return recent_days(grid, holidays, (horizon,), k, lookback).withColumnRenamed(f"h{horizon}", "forecast")


def reference_baseline(design: DataFrame) -> Column:
    """Recent-day baseline with D-7 and D-h fallbacks."""
    return F.coalesce("recent_day_baseline", "lag_7d_load", "lag_h_load")


def ordered_quantiles(p10: Column, p50: Column, p90: Column) -> tuple[Column, Column, Column]:
    """p10 <= p50 <= p90 and never negative."""
    a = F.array_sort(F.array(p10, p50, p90))
    return tuple(nonneg(F.element_at(a, i)) for i in (1, 2, 3))


def sorted_quantile(values: Column, q: float) -> Column:
    """Interpolated quantile of an ascending array; NULL for an empty one."""
    place = (F.size(values) - 1) * F.lit(q)
    low = F.get(values, F.floor(place).cast("int"))
    return low + (F.get(values, F.ceil(place).cast("int")) - low) * (place - F.floor(place))


def relative_band(df: DataFrame, point: str, horizon: int = 1, window: int = 56, min_rows: int = 7 * 96, default: float = 0.05) -> DataFrame:
    """Empirical 10 % / 90 % relative errors of the days before each target's origin, as a band around the point forecast.

    A target ``horizon`` days after its origin sees the errors of the ``window`` days that end at the origin, never later
    ones. Errors are first gathered per day (at most 96), so the window runs over the daily list.
    """
    r = F.when(F.col(point) != 0, F.col("load") / F.col(point) - 1.0)
    daily = df.groupBy(*DAY).agg(F.collect_list(r).alias("_r"))  # missing errors are left out
    before = Window.partitionBy("state").orderBy(F.unix_date("date")).rangeBetween(-(horizon + window - 1), -horizon)
    known = daily.withColumn("_e", F.array_sort(F.flatten(F.collect_list("_r").over(before))))
    band = known.select(*DAY, F.size("_e").alias("_n"), sorted_quantile(F.col("_e"), 0.1).alias("_lo"), sorted_quantile(F.col("_e"), 0.9).alias("_hi"))
    j = df.join(band, list(DAY), "left")
    use = F.coalesce(F.col("_n") >= min_rows, F.lit(False))
    lo, hi = F.when(use, F.col("_lo")).otherwise(-default), F.when(use, F.col("_hi")).otherwise(default)
    p10, p50, p90 = ordered_quantiles(F.col(point) * (1 + lo), F.col(point), F.col(point) * (1 + hi))
    return j.withColumns({"p10": p10, "p50": p50, "p90": p90}).drop("_n", "_lo", "_hi")


def complete_prior_days(df: DataFrame, date: str, window: int, min_blocks: int = 96) -> DataFrame:
    """Rows of the latest ``window`` complete days before a date (any days when none is complete)."""
    d = F.lit(date).cast("date")
    day = df.where(F.col("date") < d).groupBy(*DAY).agg(count_where(F.col("load") > 0).alias("_n"))
    day = join_stats(day, ["state"], _any=F.max(F.when(F.col("_n") >= min_blocks, 1).otherwise(0)))
    day = day.where((F.col("_any") == 0) | (F.col("_n") >= min_blocks))
    day = day.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= window)
    return df.join(day.select(*DAY), DAY, "left_semi")


def window_errors(df: DataFrame, date: str, windows: Sequence[int] = tuple(range(1, 16))) -> DataFrame:
    """MAPE of the mean of the last w days for one date, for every w at once (one cumulative pass per block)."""
    d = F.lit(date).cast("date")
    hist = df.where(F.col("date") < d).withColumn("_age", F.datediff(d, "date")).where(F.col("_age") <= max(windows))
    by = hist.groupBy(*SB).agg(*[F.avg(F.when(F.col("_age") <= w, F.col("load"))).alias(f"w{w}") for w in windows])
    act = df.where((F.col("date") == d) & (F.col("load") > 0)).select(*SB, F.col("load").alias("_a"))
    j = act.join(by, list(SB))
    items = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"w{w}").alias("base")) for w in windows])
    long = j.select(*SB, "_a", F.explode(items).alias("x")).select("state", "_a", "x.*")
    return long.groupBy("state", "window").agg((F.avg(F.abs(F.col("_a") - F.col("base")) / F.col("_a")) * 100).alias("mape"))


def best_window(errors: DataFrame, score: str = "mape") -> DataFrame:
    return errors.groupBy("state").agg(F.min_by("window", F.struct(score, "window")).alias("best_window"), F.min(score).alias(score))


def daily_window_scores(df: DataFrame, windows: Sequence[int] = tuple(range(1, 16)), feature: str = "load") -> DataFrame:
    """Rolling daily-mean prediction for windows 1..15: MAPE, its spread, score = MAPE + half the spread."""
    day = df.groupBy(*DAY).agg(F.avg(feature).alias("v"))
    o = Window.partitionBy("state").orderBy("date")
    d = day.withColumns({f"w{w}": F.when(F.count("v").over(o.rowsBetween(-w, -1)) >= w, F.avg("v").over(o.rowsBetween(-w, -1))) for w in windows})
    items = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"w{w}").alias("b")) for w in windows])
    long = d.select("state", "v", F.explode(items).alias("x")).select("state", "v", "x.*").where(F.col("b").isNotNull())
    err = F.abs(F.col("v") - F.col("b")) / F.col("v") * 100
    s = long.groupBy("state", "window").agg(F.avg(err).alias("mape"), F.stddev_pop(err).alias("stability"))
    return s.withColumn("score", F.col("mape") + 0.5 * F.col("stability"))


def weather_window_scores(df: DataFrame, windows: Sequence[int] = tuple(range(1, 16)), weight: float = 0.5, feature: str = "load") -> DataFrame:
    """As ``daily_window_scores`` with a penalty on the mean temperature difference between the day and its window."""
    day = df.groupBy(*DAY).agg(F.avg(feature).alias("v"), F.avg("temperature").alias("tm"))
    o = Window.partitionBy("state").orderBy("date")
    items = []
    for w in windows:
        f = o.rowsBetween(-w, -1)
        day = day.withColumn(f"w{w}", F.when(F.count("v").over(f) >= w, F.struct(F.avg("v").over(f).alias("b"), F.avg("tm").over(f).alias("t"))))
        items.append(F.struct(F.lit(w).alias("window"), F.col(f"w{w}").alias("x")))
    long = day.select("state", "v", "tm", F.explode(F.array(*items)).alias("e")).select("state", "v", "tm", "e.window", "e.x.b", "e.x.t").where(F.col("b").isNotNull())
    s = long.groupBy("state", "window").agg((F.avg(F.abs(F.col("v") - F.col("b")) / F.col("v")) * 100).alias("mape"), F.avg(F.abs(F.col("tm") - F.col("t"))).alias("temp_diff"))
    return s.withColumn("score", F.col("mape") + weight * F.coalesce("temp_diff", F.lit(0.0)))


def adaptive_window(df: DataFrame, feature: str = "load") -> DataFrame:
    """3, 5 or 7 days per state from the month, the variation of recent daily means and the number of rainy days."""
    day = df.groupBy(*DAY).agg(F.avg(feature).alias("v"), F.sum("precipitation").alias("rain"))
    day = day.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date"))))
    recent = day.where("_r <= 7").groupBy("state").agg(ratio(F.stddev_pop("v"), F.avg("v")).alias("load_cv"), count_where(F.col("rain") > 2.0).alias("rainy_days"), F.max("date").alias("last"))
    unstable = (F.col("load_cv") > 0.08) | (F.col("rainy_days") >= 3)
    monsoon = F.month("last").isin(6, 7, 8, 9)
    return recent.withColumn("window", F.when(unstable, 3).when(monsoon | (F.col("load_cv") > 0.04), 5).otherwise(7))


def causal_baseline(df: DataFrame, k: int = 2, pool: int = 7, sigma: float = 1.8, start_block: int = 33) -> DataFrame:
    """Mean of the k latest clean rotated days among the ``pool`` days before; a day whose mean is sigma away is not clean.

    The choice is made on the daily list: every day is offered to the next days on record, filtered and ranked there,
    and only then joined with the blocks.
    """
    rd, rb = rotated("date", "block", start_block)
    d = df.where(F.col("load").isNotNull()).select("state", rd.alias("rot_date"), rb.alias("rot_block"), "load")
    day = d.groupBy("state", "rot_date").agg(F.avg("load").alias("_m"))
    day = day.withColumn("_i", F.row_number().over(Window.partitionBy("state").orderBy("rot_date")))
    offer = day.select("state", F.col("rot_date").alias("cand"), F.col("_m").alias("_cm"), F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + pool)).alias("_i"))
    offer = offer.join(day.select("state", "rot_date", "_i"), ["state", "_i"])
    w = Window.partitionBy("state", "rot_date")
    n, mu, sd = F.count(F.lit(1)).over(w), F.avg("_cm").over(w), F.stddev_samp("_cm").over(w)
    clean = F.when((n >= 3) & (sd > 0), F.abs(F.col("_cm") - mu) <= sigma * sd).otherwise(True)
    offer = offer.withColumn("_clean", clean)
    keep = F.when(F.sum(F.col("_clean").cast("int")).over(w) >= 2, F.col("_clean")).otherwise(True)
    offer = offer.withColumn("_keep", keep).where("_keep").withColumn("_r", F.row_number().over(w.orderBy(F.desc("cand")))).where(F.col("_r") <= k)
    vals = d.groupBy("state", F.col("rot_date").alias("cand"), "rot_block").agg(F.avg("load").alias("_v"))
    return offer.select("state", "cand", "rot_date").join(vals, ["state", "cand"]).groupBy("state", "rot_date", "rot_block").agg(F.avg("_v").alias("baseline"))


def persistence_48h(df: DataFrame, window: int = 7, feature: str = "load") -> DataFrame:
    """Block mean of the last days repeated over the next two days, with +-1.96 sigma."""
    j = join_stats(df.select("state", "date", "block", feature), ["state"], _last=F.max("date"))
    prof = j.where(F.col("date") > F.date_sub("_last", window)).groupBy("state", "block").agg(F.avg(feature).alias("forecast"), F.stddev_samp(feature).alias("_s"), F.max("_last").alias("_last"))
    out = prof.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).select("state", F.date_add("_last", F.col("_k")).alias("date"), "block", "forecast", "_s")
    return out.withColumn("upper", F.col("forecast") + 1.96 * F.col("_s")).withColumn("lower", nonneg(F.col("forecast") - 1.96 * F.col("_s"))).drop("_s")


def synthetic_day(df: DataFrame, template: str, date: str) -> DataFrame:
    """Rows of a template day under a new date, marked synthetic, load left open."""
    d = df.where(F.col("date") == F.lit(template).cast("date"))
    days = d.select(*DAY).distinct()
    g = blocks_of_days(days).join(d, [*DAY, "block"], "left")
    return g.withColumn("date", F.lit(date).cast("date")).withColumn("load", F.lit(None).cast("double")).withColumn("synthetic", F.lit(1))


def naive_residuals(df: DataFrame, k: int = 7) -> DataFrame:
    """Residuals of the per-block lag-k forecast."""
    return df.withColumn("naive", day_lag("load", k)).where("naive is not null and load is not null").withColumn("residual", F.col("load") - F.col("naive"))


def residual_summary(res: DataFrame) -> DataFrame:
    r = F.col("residual")
    return res.groupBy("state").agg((F.avg(F.abs(ratio(r, "load"))) * 100).alias("mape_pct"), F.sqrt(F.avg(r * r)).alias("rmse_mw"), F.avg(r).alias("bias_mw"),
                                    F.max(r).alias("max_under_forecast_mw"), F.min(r).alias("max_over_forecast_mw"))


def inverse_rmse_blend(df: DataFrame, validation_days: int = 7, actual: str = "load", forecast: str = "forecast") -> DataFrame:
    """Several models' forecasts weighted by 1 / RMSE over each state's last validation days with an actual."""
    val = df.where(F.col(actual).isNotNull())
    last = val.groupBy("state").agg(F.max("date").alias("_last"))
    val = val.join(last, "state").where(F.col("date") > F.date_sub("_last", validation_days))
    e = F.col(actual) - F.col(forecast)
    w = val.groupBy("state", "model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    j = df.join(w, ["state", "model"]).where(F.col("rmse") > 0)
    return j.groupBy("state", "date", "block").agg((F.sum(F.col(forecast) / F.col("rmse")) / F.sum(1.0 / F.col("rmse"))).alias("blend"), F.count(F.lit(1)).alias("models"))


def assemble(df: DataFrame, half_life: float = 24.0, settled: int = 0) -> DataFrame:
    """Final additive forecast: baseline + calendar offset + level correction that decays with distance; actuals stay.

    Needs baseline, calendar_offset, level_correction, block, load.
    """
    dist = F.greatest(F.col("block") - settled, F.lit(0))
    level = F.coalesce("level_correction", F.lit(0.0)) * F.exp(-0.693 * dist / half_life)
    fc = nonneg(F.col("baseline") + F.coalesce("calendar_offset", F.lit(0.0)) + level)
    return df.withColumn("corr_level", level).withColumn("forecast", F.when((F.col("block") <= settled) & F.col("load").isNotNull(), F.col("load")).otherwise(fc))


def normal_band(df: DataFrame, point: str = "forecast", sigma: str = "sigma") -> DataFrame:
    """p10 / p90 from a normal residual spread, and confidence = 100 - relative band."""
    f, s = F.col(point), F.col(sigma)
    p10, p90 = nonneg(f - 1.2816 * s), f + 1.2816 * s
    conf = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - ratio(p90 - p10, f) * 100.0))
    return df.withColumn("p10", p10).withColumn("p90", p90).withColumn("confidence", conf)


def block_sigma(df: DataFrame, window: int = 28) -> DataFrame:
    """Spread of the residuals of each block over the days before."""
    return df.withColumn("sigma", F.stddev_pop(F.col("actual") - F.col("forecast")).over(days_ago(SB, window, 1)))
