"""Feature frames. Lags are keyed by day and block, rolling windows by absolute quarter hour."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import cyclic, hour_of, rotated
from quarterhour.functions.numbers import clip, ratio
from quarterhour.functions.physics import STULL, degrees_above, degrees_below
from quarterhour.functions.stats import quantile
from quarterhour.operators.calendar import holiday_distance, holiday_flag
from quarterhour.operators.grid import blocks_back, core_rows, day_lag, days_ago, rolling, sliced

SERIES = ("state", "block")


def join_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates. Partial aggregation keeps a hot group off a single task, unlike a window."""
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(stats, list(keys), "left")


def season4(month: Column | str) -> Column:
    m = F.col(month) if isinstance(month, str) else month
    return (F.when(m.isin(12, 1, 2), "Winter").when(m.isin(3, 4, 5), "Spring").when(m.isin(6, 7, 8), "Summer").otherwise("Fall"))


def time_of_day(hour: Column | str) -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return F.when(h <= 6, "Night").when(h <= 12, "Morning").when(h <= 18, "Afternoon").otherwise("Evening")


def rain_class(p: Column | str) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p <= 0.01, "None").when(p <= 1, "Light").when(p <= 5, "Moderate").when(p <= 20, "Heavy").when(p <= 1000, "Storm"))


def heat_index(t: Column | str, h: Column | str) -> Column:
    t, h = F.col(t) if isinstance(t, str) else t, F.col(h) if isinstance(h, str) else h
    return 0.5 * (t + 61.0 + (t - 68.0) * 1.2 + h * 0.094)


def with_lags(df: DataFrame) -> DataFrame:
    """Day lags of load and temperature and per-block level and spread, all on one (state, block) shuffle."""
    w = Window.partitionBy(*SERIES)
    return df.withColumns({
        "d1": day_lag("load", 1), "d2": day_lag("load", 2), "d7": day_lag("load", 7),
        "temp_d1": day_lag("temperature", 1), "temp_d7": day_lag("temperature", 7),
        "roll7_block": F.avg("load").over(days_ago(SERIES, 6, 0)),
        "block_mean": F.avg("load").over(w), "block_std": F.stddev_samp("load").over(w),
    }).withColumn("roll7_trend", F.col("roll7_block") - F.max("roll7_block").over(days_ago(SERIES, 7)))


def with_baseline(df: DataFrame, window: int = 7) -> DataFrame:
    """Mean of the same block over the days before, for load and weather (the row's own day never enters)."""
    w = days_ago(SERIES, window, 1)
    return df.withColumns({"baseline": F.avg("load").over(w), "n_temp": F.avg("temperature").over(w),
                           "n_hum": F.avg("humidity").over(w), "n_rain": F.avg("precipitation").over(w)})


def with_rolling(df: DataFrame) -> DataFrame:
    """Previous quarter hour, 3 h / 6 h / 24-block / 7-day trailing means, on halo slices."""
    s = sliced(df, back=672)
    s = s.withColumns({
        "prev": blocks_back("load", 1), "temp_roll_3h": rolling(F.avg("temperature"), 12), "temp_roll_6h": rolling(F.avg("temperature"), 24),
        "load_last_24": rolling(F.avg("load"), 24), "temp_roll_7d": rolling(F.avg("temperature"), 672),
        "hum_roll_7d": rolling(F.avg("humidity"), 672), "load_roll_7d_std": rolling(F.stddev_samp("load"), 672),
    })
    return core_rows(s).withColumn("ramp", F.col("load") - F.col("prev"))


def eda_frame(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Exploration frame: calendar, holiday context, cyclic terms, weather powers and products, lags, baselines, volatility.

    Needs state, date, block, load, dow, is_weekend, is_holiday, hour, month and weather. The holiday context is
    computed once per day and joined back.
    """
    days = df.select("date").distinct()
    ctx = holiday_distance(holiday_flag(holiday_flag(days, holidays, "_p", -1), holidays, "_n", 1), holidays)
    df = df.join(ctx, "date", "left")
    adj = (F.col("_p") == 1) | (F.col("_n") == 1)
    bs, bc = cyclic(F.col("block") - 1, 96.0)
    hs, hc = cyclic(F.col("hour"), 24.0)
    df = df.withColumns({
        "season": season4("month"), "time_of_day": time_of_day("hour"), "is_monday": (F.col("dow") == 0).cast("int"),
        "is_friday": (F.col("dow") == 4).cast("int"), "block_sin": bs, "block_cos": bc, "hour_sin": hs, "hour_cos": hc,
        "is_morning_peak": F.col("hour").between(7, 10).cast("int"), "is_evening_peak": F.col("hour").between(18, 22).cast("int"),
        "is_night_valley": F.col("hour").between(1, 5).cast("int"),
        "holiday_before_weekend": ((F.col("is_holiday") == 1) & (F.col("dow") == 4)).cast("int"),
        "holiday_after_weekend": ((F.col("is_holiday") == 1) & (F.col("dow") == 0)).cast("int"),
        "bridge_day": ((F.col("is_holiday") == 0) & (F.col("dow") < 5) & adj).cast("int"),
        "long_weekend": ((F.col("dow") >= 5) & adj).cast("int"),
        "cooling_degree": degrees_above("temperature", 24.0), "heat_index": heat_index("temperature", "humidity"),
        "rain_proxy": (F.col("precipitation") > 0.1).cast("int"), "rain_intensity": rain_class("precipitation"),
        "is_heavy_rain": (F.col("precipitation") > 5).cast("int"),
    }).drop("_p", "_n")
    more = {}
    for c in ("temperature", "humidity", "precipitation"):
        more[f"{c}_sq"], more[f"{c}_cb"] = F.col(c) * F.col(c), F.col(c) * F.col(c) * F.col(c)
        for e in ("block_sin", "block_cos", "hour_sin", "hour_cos"):
            more[f"{c}_x_{e}"] = F.col(c) * F.col(e)
    # group statistics come from the plain rows, not from the frame with all its windows, so the chain runs once
    base = df.select("state", "season", "dow", "block", "load")
    season_mean = base.groupBy("state", "season").agg(F.avg("load").alias("seasonal_profile"))
    dow_mean = base.groupBy("state", "dow").agg(F.avg("load").alias("weekly_profile"))
    blk = base.groupBy("state", "block").agg(F.avg("load").alias("_m"), F.stddev_samp("load").alias("_sd"))
    score = F.abs(F.col("load") - F.col("_m")) / (F.col("_sd") + 1e-6)
    level = base.join(blk, ["state", "block"]).groupBy("state").agg(F.avg("_sd").alias("_bm"), F.stddev_samp("_sd").alias("_bs"), quantile(score, 0.95).alias("_q"))
    df = df.withColumns(more).join(season_mean, ["state", "season"], "left").join(dow_mean, ["state", "dow"], "left").join(level, "state", "left")
    df = with_rolling(with_lags(df))
    df = df.withColumns({
        "dod_change": F.col("load") - F.col("d1"), "wow_change": F.col("load") - F.col("d7"),
        "temp_x_peak": F.col("temperature") * F.col("is_evening_peak"), "weather_x_load": F.col("temperature") * F.col("load"),
        "block_x_d1": F.col("block") * F.col("d1"), "weekend_load": F.col("load") * F.col("is_weekend"),
        "holiday_load": F.col("load") * F.col("is_holiday"), "baseline_dev": F.col("load") - F.col("block_mean"),
        "dev_score": F.abs(F.col("load") - F.col("block_mean")) / (F.col("block_std") + 1e-6),
    })
    return df.withColumns({
        "variance_score": (F.col("block_std") - F.col("_bm")) / (F.col("_bs") + 1e-6),
        "peak_volatility": F.when(F.col("dev_score") > F.col("_q"), 1).otherwise(0),
    }).drop("_bm", "_bs", "_q")


def time_features(df: DataFrame) -> DataFrame:
    """Peak, night and business flags, cyclic encodings and temperature terms of the modelling frames."""
    h, dow, t = hour_of("block"), F.weekday("date"), F.col("temperature")
    bs, bc = cyclic(F.col("block") - 1, 96.0)
    ds, dc = cyclic(dow, 7.0)
    hs, hc = cyclic(h, 24.0)
    return df.withColumns({
        "hour": h, "day_of_week": dow, "day_of_month": F.dayofmonth("date"), "month": F.month("date"), "is_weekend": (dow >= 5).cast("int"),
        "hour_cos": hc, "dow_sin": ds, "dow_cos": dc, "block_sin": bs, "block_cos": bc,
        "is_peak_hour": h.isin(7, 8, 9, 18, 19, 20).cast("int"), "is_night": (h <= 6).cast("int"), "is_business_hour": h.between(9, 17).cast("int"),
        "temp_squared": t * t, "temp_cubed": t * t * t, "temperature_sin": t * hs,
    })


def kpi_features(df: DataFrame) -> DataFrame:
    """Degree terms (24 / 18), heat index, rain and cloud flags, solar index, 7-day baseline and spread, day lags."""
    df = df.withColumns({
        "cooling_degree_days": degrees_above("temperature", 24.0), "heating_degree_days": degrees_below("temperature", 18.0),
        "heat_index": heat_index("temperature", "humidity"), "rain_flag": (F.col("precipitation") > 0.1).cast("int"),
        "humidity_index": F.col("humidity") / 100.0, "cloud_flag": (F.col("cloud_cover") > 0.5).cast("int"),
        "solar_index": F.when(F.col("direct_radiation").isNotNull(), F.least(F.col("direct_radiation") / 1000.0, F.lit(1.0))),
        "d1": day_lag("load", 1), "d7": day_lag("load", 7),
    })
    s = sliced(df, back=671)
    return core_rows(s.withColumns({"rolling_baseline": rolling(F.avg("load"), 672), "rolling_volatility": rolling(F.stddev_samp("load"), 672)}))


def series_frame(df: DataFrame) -> DataFrame:
    """The part of the exploration frame that KPI tables need: day lags, block level and spread, ramp, simple products.

    Two shuffles in all, one on (state, block) and one on (state, slice).
    """
    w = Window.partitionBy(*SERIES)
    df = df.withColumns({
        "d1": day_lag("load", 1), "d7": day_lag("load", 7), "roll7_block": F.avg("load").over(days_ago(SERIES, 6, 0)),
        "block_mean": F.avg("load").over(w), "block_std": F.stddev_samp("load").over(w),
        "season": season4("month"), "is_evening_peak": F.col("hour").between(18, 22).cast("int"),
        "cooling_degree": degrees_above("temperature", 24.0), "heat_index": heat_index("temperature", "humidity"),
        "rain_proxy": (F.col("precipitation") > 0.1).cast("int"), "weather_x_load": F.col("temperature") * F.col("load"),
    })
    df = core_rows(sliced(df, back=1).withColumn("prev", blocks_back("load", 1)))
    return df.withColumns({
        "ramp": F.col("load") - F.col("prev"), "temp_x_peak": F.col("temperature") * F.col("is_evening_peak"),
        "baseline_dev": F.col("load") - F.col("block_mean"), "dev_score": F.abs(F.col("load") - F.col("block_mean")) / (F.col("block_std") + 1e-6)})


def rolling_spread(df: DataFrame, blocks: int = 672, value: str = "load", out: str = "load_roll_7d_std") -> DataFrame:
    return core_rows(sliced(df, back=blocks - 1).withColumn(out, rolling(F.stddev_samp(value), blocks)))


def volatility_flag(df: DataFrame) -> DataFrame:
    """1 where the deviation score exceeds its 95th percentile in the state."""
    j = join_stats(df, ["state"], _q=quantile("dev_score", 0.95))
    return j.withColumn("peak_volatility", F.when(F.col("dev_score") > F.col("_q"), 1).otherwise(0)).drop("_q")


def day_context(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Bridge and long-weekend flags and holiday distances of each date (one row per date)."""
    dow = F.weekday("date")
    ctx = holiday_distance(holiday_flag(holiday_flag(holiday_flag(days, holidays), holidays, "_p", -1), holidays, "_n", 1), holidays)
    adj = (F.col("_p") == 1) | (F.col("_n") == 1)
    return ctx.withColumns({"bridge_day": ((F.col("is_holiday") == 0) & (dow < 5) & adj).cast("int"),
                            "long_weekend": ((dow >= 5) & adj).cast("int")}).drop("_p", "_n", "is_holiday")


# --- modelling frames ---------------------------------------------------------------------------------------------


def wet_bulb_raw(t: Column, rh: Column) -> Column:
    """Stull formula without the validity range (inputs are pre-filled in these frames)."""
    a, b, c, d, e, f, g = STULL
    return t * F.atan(a * F.sqrt(rh + b)) + F.atan(t + rh) - F.atan(rh - c) + d * F.pow(rh, F.lit(e)) * F.atan(f * rh) - g


def training_frame(df: DataFrame, cdd_base: float = 24.0, hdd_base: float = 15.0) -> DataFrame:
    """Model features per block. Lags are keyed by day and block; rolling loads exclude the current block.

    Needs state, date, block, load and weather. Three shuffles: (state, block), (state, slice) and (state, date).
    """
    t, h = F.col("temperature"), F.col("humidity")
    rh = F.least(F.greatest(h, F.lit(0.0)), F.lit(100.0))
    day = df.groupBy("state", "date").agg(F.avg("load").alias("_dm"), F.avg(F.when(F.col("block").between(1, 32), F.col("load"))).alias("_night"))
    df = time_features(df).withColumns({
        "cdd": degrees_above(t, cdd_base), "hdd": degrees_below(t, hdd_base), "wbgt": 0.7 * wet_bulb_raw(t, rh) + 0.3 * t,
        "solar_proxy_mw": F.greatest(F.coalesce("direct_radiation", F.lit(0.0)), F.lit(0.0)) * (1 - clip(F.coalesce("cloud_cover", F.lit(50.0)), 0.0, 100.0) / 100.0) * 0.001,
        "temp_quartic": t * t * t * t / 1e6, "ramp_heat": t * F.when(F.col("block").between(48, 68), 1.0).otherwise(0.0),
        "season_idx": F.when(F.col("month").isin(12, 1, 2), 0).when(F.col("month").isin(3, 4, 5), 1).when(F.col("month").isin(6, 7, 8), 2).otherwise(3),
    })
    df = df.withColumns({**{f"load_lag_{k}d": day_lag("load", k) for k in (1, 2, 3, 7)},
                         "load_rolling_7d": F.avg("load").over(days_ago(SERIES, 7, 1)), "_t3": day_lag("temperature", 3)})
    s = sliced(df, back=288)
    w = Window.partitionBy("state", "_slice").orderBy("t")
    before = lambda n: F.avg("load").over(w.rangeBetween(-n, -1))
    df = core_rows(s.withColumns({
        "temp_roll_3h": rolling(F.avg("temperature"), 12), "temp_roll_6h": rolling(F.avg("temperature"), 24), "lag_block_1": blocks_back("load", 1),
        "lag_block_4": blocks_back("load", 4), "rolling_4": before(4), "rolling_12": before(12),
        **{f"cdh_{n // 4}h": rolling(F.sum("cdd"), n) for n in (96, 192, 288)}}))
    nw = days_ago(("state",), 8, 2)
    day = day.withColumns({"load_trend_3d": F.col("_dm") - day_lag("_dm", 3, ("state",)), "_pn": day_lag("_night", 1, ("state",)),
                           "_pr": F.when(F.count("_night").over(nw) >= 2, F.avg("_night").over(nw))})
    day = day.withColumn("prev_night_dip", F.when(F.abs(ratio(F.col("_pn") - F.col("_pr"), "_pr")) > 0.15, 1.0).otherwise(0.0))
    df = df.join(day.select("state", "date", "load_trend_3d", "prev_night_dip"), ["state", "date"])
    return df.withColumns({
        "load_x_cdd": F.col("load_lag_1d") * F.col("cdd"), "load_x_humidity": F.col("load_lag_1d") * h / 100.0, "cdd_squared": F.col("cdd") * F.col("cdd"),
        "wbgt_x_load": F.col("wbgt") * F.col("load_rolling_7d"), "temp_momentum_3d": t - F.coalesce("_t3", t)}).drop("_t3", "t")


MODEL_FEATURES = [
    "temperature", "humidity", "precipitation", "cdd", "hdd", "temp_roll_3h", "temp_roll_6h", "wbgt", "cdh_24h", "cdh_48h", "cdh_72h", "cloud_cover",
    "direct_radiation", "wind_speed_10m", "solar_proxy_mw", "block_sin", "block_cos", "is_weekend", "season_idx", "hour_cos", "dow_sin", "dow_cos",
    "is_peak_hour", "is_night", "is_business_hour", "temp_squared", "temp_cubed", "temp_quartic", "temperature_sin", "ramp_heat", "lag_block_1", "lag_block_4",
    "rolling_4", "rolling_12", "load_lag_1d", "load_lag_2d", "load_lag_3d", "load_lag_7d", "load_rolling_7d", "load_trend_3d", "load_x_cdd", "load_x_humidity",
    "cdd_squared", "wbgt_x_load", "temp_momentum_3d", "prev_night_dip",
]


def thermal_solar(df: DataFrame) -> DataFrame:
    """Degree terms, wet-bulb globe index, accumulated degree hours, momentum, solar index, rain and wind severity, extremes."""
    t, h = F.coalesce("temperature", F.lit(25.0)), F.coalesce("humidity", F.lit(50.0))
    r, cc = F.coalesce("direct_radiation", F.lit(0.0)), clip(F.coalesce("cloud_cover", F.lit(0.0)), 0.0, 100.0)
    df = df.withColumns({"cdd": F.greatest(t - 24.0, F.lit(0.0)), "hdd": F.greatest(15.0 - t, F.lit(0.0)), "wbgt": 0.7 * wet_bulb_raw(t, h) + 0.3 * t, "_t": t, "_r": r,
                         "precip_severity": clip(F.log1p(F.coalesce("precipitation", F.lit(0.0))) / math.log1p(10.0), 0.0, 1.0),
                         "wind_severity": clip((F.coalesce("wind_speed_10m", F.lit(0.0)) - 15.0) / 30.0, 0.0, 1.0),
                         "is_extreme_heat": (t >= 42.0).cast("int"), "is_extreme_cold": (t <= 8.0).cast("int")})
    df = join_stats(df, ["state"], _mx=F.greatest(F.max("_r"), F.lit(1.0)))
    df = df.withColumn("solar_index", F.col("_r") / F.col("_mx") * (1.0 - cc / 100.0))
    s = sliced(df, back=288)
    return core_rows(s.withColumns({"cdh_24h": rolling(F.sum("cdd"), 96), "temp_momentum_3d": F.col("_t") - blocks_back("_t", 288)})).drop("_t", "_r", "_mx", "t")


def weather_deltas(df: DataFrame, columns: Sequence[str] = ("temperature", "humidity", "precipitation", "cloud_cover", "direct_radiation", "wind_speed_10m")) -> DataFrame:
    """Change of each weather column to the same block of the day before."""
    return df.withColumns({f"{c}_delta": F.col(c) - day_lag(c, 1) for c in columns})


def guarded_lags(df: DataFrame, sigma: float = 1.8, pool: int = 14) -> DataFrame:
    """Lag 1 replaced by lag 7 where yesterday's mean was anomalous against its own trailing days; 7-day mean of lag 1."""
    day = df.groupBy("state", "date").agg(F.avg("load").alias("_m"))
    w = days_ago(("state",), pool, 1)
    day = day.withColumn("_mu", F.avg("_m").over(w)).withColumn("_sd", F.greatest(F.coalesce(F.stddev_samp("_m").over(w), F.lit(0.0)), F.lit(1.0)))
    day = day.withColumn("day_anomalous", F.coalesce(F.abs(F.col("_m") - F.col("_mu")) > sigma * F.col("_sd"), F.lit(False)))
    bad = F.coalesce(F.max(F.col("day_anomalous").cast("int")).over(days_ago(("state",), 1)), F.lit(0)) == 1
    day = day.withColumn("prev_anomalous", bad).select("state", "date", "day_anomalous", "prev_anomalous")
    d = df.withColumns({"_l1": day_lag("load", 1), "lag_7d": day_lag("load", 7), "load_rolling_7d": F.avg("load").over(days_ago(SERIES, 7, 1))})
    return d.join(day, ["state", "date"]).withColumn("lag_1d", F.when(F.col("prev_anomalous"), F.col("lag_7d")).otherwise(F.col("_l1"))).drop("_l1")


def rotated_features(df: DataFrame, start_block: int = 33) -> DataFrame:
    """Rotated date and block with their encodings and flags."""
    rd, rb = rotated("date", "block", start_block)
    df = df.withColumn("rot_date", rd).withColumn("rot_block", rb)
    dow, h = F.weekday("rot_date"), hour_of("block")
    bs, bc = cyclic(F.col("rot_block") - 1, 96.0)
    ds, dc = cyclic(dow, 7.0)
    return df.withColumns({"rot_block_sin": bs, "rot_block_cos": bc, "dow_sin": ds, "dow_cos": dc, "is_sunday": (dow == 6).cast("int"), "is_weekend": (dow >= 5).cast("int"),
                           "is_peak_hour": h.isin(7, 8, 9, 18, 19, 20).cast("int"), "is_night": (h <= 6).cast("int")})


def training_windows(df: DataFrame, columns: Sequence[str], future_days: int = 1, start_block: int = 33, history_share: float = 0.9, future_share: float = 0.95) -> DataFrame:
    """One row per rotated day: the 96 blocks before it and its ``future_days`` x 96 blocks, as arrays of structs.

    Each block row is sent to the few windows it belongs to, so a window is one bounded group.
    """
    rd, rb = rotated("date", "block", start_block)
    item = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    d = df.select("state", rd.alias("_rd"), rb.alias("rot_block"), item.alias("x"))
    d = d.select("state", "_rd", "rot_block", "x", F.explode(F.sequence(F.lit(-(future_days - 1)), F.lit(1))).alias("_k"))
    d = d.select("state", F.date_add("_rd", F.col("_k")).alias("rot_date"), (F.col("rot_block") - 96 * F.col("_k")).alias("pos"), "x")
    a = d.groupBy("state", "rot_date").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos") <= 0, F.struct("pos", "x")))).alias("h"),
        F.array_sort(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "x")))).alias("f"))
    ok = (F.size("h") >= int(history_share * 96)) & (F.size("f") >= int(future_share * 96 * future_days))
    return a.where(ok).select("state", "rot_date", F.transform("h", lambda e: e["x"]).alias("history"), F.transform("f", lambda e: e["x"]).alias("future"))


# Weights of the weather action terms and their cap.
ACTION_WEIGHTS = {"temp": 0.8, "precip": 1.8, "wind": 1.5, "sunday": 0.8, "holiday": 1.2, "cap": 6.0}


def sample_weights(df: DataFrame) -> DataFrame:
    """Training weight of a block from temperature change, rain, wind, Sunday and holiday, between 1 and the cap."""
    k = ACTION_WEIGHTS
    day = Window.partitionBy("state", "rot_date").orderBy("rot_block")
    dt = F.coalesce(F.col("temperature") - F.lag("temperature").over(day), F.lit(0.0))
    wind = F.greatest(F.lit(0.0), F.coalesce("wind_speed_10m", F.lit(0.0)) - 15.0) / 30.0
    w = (1.0 + k["temp"] * F.abs(dt) + k["precip"] * F.log1p(F.greatest(F.lit(0.0), F.coalesce("precipitation", F.lit(0.0)))) + k["wind"] * wind
         + k["sunday"] * F.col("is_sunday") + k["holiday"] * F.col("is_holiday"))
    return df.withColumn("weight", F.least(F.greatest(w, F.lit(1.0)), F.lit(k["cap"])))


def inference_frame(history: DataFrame, target: DataFrame, baseline: str = "baseline") -> DataFrame:
    """History and target rows stacked; a target block takes its actual where settled, else the baseline as load anchor."""
    h = history.withColumn("is_target", F.lit(0)).withColumn("load_source", F.col("load"))
    t = target.withColumn("is_target", F.lit(1)).withColumn("load_source", F.coalesce("load", baseline))
    return h.unionByName(t, allowMissingColumns=True)


def impute_median(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES) -> DataFrame:
    """Gaps take the median of the block, else of the state."""
    blk = df.groupBy(*keys).agg(*[F.median(c).alias(f"_b_{c}") for c in columns])
    st = df.groupBy("state").agg(*[F.median(c).alias(f"_s_{c}") for c in columns])
    j = df.join(blk, list(keys), "left").join(st, "state", "left")
    return j.withColumns({c: F.coalesce(c, f"_b_{c}", f"_s_{c}") for c in columns}).drop(*[f"_{p}_{c}" for p in "bs" for c in columns])


def external_features(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[str]]:
    """Hook for a caller's feature function; returns the frame and the numeric columns it added."""
    out = df.transform(fn)
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return out, [c for c, t in out.dtypes if c not in df.columns and t in numeric]
