"""Forecast corrections. Each is a DataFrame -> DataFrame step for all states and dates at once.

Rows are (state, date, block) with ``forecast`` and, where known, ``actual``. ``settled`` is the number of blocks of a
day whose actuals are taken as known; a step never reads an actual after it, except for days before the target date.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import clip, nonneg, ratio
from quarterhour.functions.stats import avg_where, count_where, intercept, slope
from quarterhour.operators.decompose import circular_smooth, ema_of_day, edge_padded_smooth, recency_weighted
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import day_lag, days_ago, interpolate
from quarterhour.operators.weather import heat_index_polynomial, weather_regime

DAY = ["state", "date"]
SB = ("state", "block")


def zero() -> Column:
    return F.lit(0.0)


def recent_dates(df: DataFrame, date: str, n: int) -> DataFrame:
    """The (state, date) pairs of the last n dates on record before a date."""
    d = df.where(F.col("date") < F.lit(date).cast("date")).select(*DAY).distinct()
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= n).drop("_r")


def full_blocks(df: DataFrame) -> DataFrame:
    return df.select("state").distinct().withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(96))))


# --- block bias -----------------------------------------------------------------------------------------------------


def proxy_errors(df: DataFrame, window: int = 30, night_limit: float = 0.15, feature: str = "load") -> DataFrame:
    """Causal stand-in where no forecast is stored: mean of the block's last days minus the actual.

    Days whose night blocks (1..32) left their own trailing means by more than the limit on average are left out.
    """
    w, wn = days_ago(SB, window, 1), days_ago(SB, 7, 1)
    d = df.withColumns({"_p": F.when(F.count(feature).over(w) >= 3, F.avg(feature).over(w)), "_n": F.when(F.count(feature).over(wn) >= 2, F.avg(feature).over(wn))})
    night = d.where(F.col("block") <= 32).groupBy(*DAY).agg(F.avg(F.abs(ratio(F.col(feature) - F.col("_n"), "_n"))).alias("_dev"))
    d = d.join(night, DAY, "left").where(F.coalesce(F.col("_dev"), zero()) <= night_limit)
    return d.where("_p is not null").select(*DAY, "block", (F.col("_p") - F.col(feature)).alias("error"))


def bias_table(errors: DataFrame, date: str, window: int = 30, day_type: str = "all", smooth: int = 4) -> DataFrame:
    """Median forecast-minus-actual per block over the last dates before a date, gaps interpolated, smoothed.

    A weekday / weekend filter applies only where it leaves at least three dates.
    """
    e = errors.join(recent_dates(errors, date, window), DAY, "left_semi")
    if day_type != "all":
        want = (F.weekday("date") >= 5) if day_type == "weekend" else (F.weekday("date") < 5)
        days = e.select(*DAY).distinct().withColumn("_m", want)
        e = e.join(join_stats(days, ["state"], _k=count_where(F.col("_m"))), DAY).where((F.col("_k") < 3) | F.col("_m"))
    med = e.groupBy("state", "block").agg(F.median("error").alias("raw"), F.count("error").alias("samples"))
    g = interpolate(full_blocks(errors).join(med, ["state", "block"], "left"), "raw", ["state"], "block")
    g = g.withColumn("raw", F.coalesce("raw", zero()))
    return g.withColumn("bias", edge_padded_smooth("raw", smooth, ["state"])).select("state", "block", "raw", "bias", F.coalesce("samples", F.lit(0)).alias("samples"))


def apply_bias(df: DataFrame, table: DataFrame, settled: int = 0) -> DataFrame:
    """Subtract the bias from the blocks after the settled ones; never below zero. The table has 96 rows per state."""
    j = df.join(table.select("state", "block", "bias"), ["state", "block"], "left").withColumn("applied", F.when(F.col("block") > settled, -F.coalesce("bias", zero())).otherwise(0.0))
    return j.withColumn("corrected", F.when(F.col("block") > settled, nonneg(F.col("forecast") + F.col("applied"))).otherwise(F.col("forecast"))).drop("bias")


def block_type(block: Column, weekend: Column) -> Column:
    h = F.floor((block - 1) / 4)
    part = F.when(h < 6, "night").when(h < 12, "morning_peak").when(h < 18, "afternoon").otherwise("evening")
    return F.concat(part, F.when(weekend, "_weekend").otherwise("_weekday"))


def block_type_calibration(df: DataFrame, history: DataFrame, date: str, window: int = 21, settled: int = 0, min_confidence: float = 0.8, confidence: str | None = None) -> DataFrame:
    """Median error of the block's day part and day type over the last dates before ``date``, taken off confident future blocks
    of that date and all later ones."""
    h = history.join(recent_dates(history, date, window), DAY, "left_semi")
    h = h.withColumn("_t", block_type(F.col("block"), F.weekday("date") >= 5))
    med = h.groupBy("state", "_t").agg(F.median(F.col("forecast") - F.col("actual")).alias("_e"))
    d = df.where(F.col("date") >= F.lit(date).cast("date")).withColumn("_t", block_type(F.col("block"), F.weekday("date") >= 5)).join(med, ["state", "_t"], "left")
    ok = F.col("block") > settled
    if confidence:
        ok = ok & (F.col(confidence) >= min_confidence)
    d = d.withColumn("applied", F.when(ok, -F.coalesce("_e", zero())).otherwise(0.0))
    return d.withColumn("calibrated", F.when(F.col("block") > settled, nonneg(F.col("forecast") + F.col("applied"))).otherwise(F.col("forecast"))).drop("_t", "_e")


# --- T+2 ------------------------------------------------------------------------------------------------------------


def night_taper(block: Column) -> Column:
    """1 up to block 32, falling to 0.3 at block 48, 0 afterwards."""
    return F.when(block <= 32, 1.0).when(block <= 48, 1.0 - 0.7 * (block - 33) / 15.0).otherwise(0.0)


def t2_night_table(errors: DataFrame, min_samples: int = 7, fallback: float = 350.0, early_scale: float = 1.15) -> DataFrame:
    """Negative median T+2 error per block with enough samples; a fixed night value where no night block has any; tapered."""
    e = errors.groupBy("state", "block").agg(F.median("error").alias("_m"), F.count("error").alias("samples"))
    g = full_blocks(errors).join(e, ["state", "block"], "left").withColumn("_c", F.when(F.col("samples") >= min_samples, -F.col("_m")).otherwise(0.0))
    g = join_stats(g, ["state"], _any=F.max(F.when((F.col("block") <= 32) & (F.abs("_c") > 1e-6), 1).otherwise(0)))
    fb = F.when(F.col("block") <= 16, fallback * early_scale).when(F.col("block") <= 32, fallback)
    c = F.when((F.col("_any") == 0) & (F.col("block") <= 32), fb).otherwise(F.col("_c"))
    return g.select("state", "block", (c * night_taper(F.col("block"))).alias("correction"), F.coalesce("samples", F.lit(0)).alias("samples"))


# First block of each two-hour segment -> MW to add to T+2.
T2_SEGMENT_MW = {1: 71.0, 9: 96.0, 17: 75.0, 25: -133.0, 33: -1.0, 41: 28.0, 49: 200.0, 57: 260.0, 65: -7.0, 73: -280.0, 81: -90.0, 89: 200.0}


def t2_segment_table(df: DataFrame, blend: float = 1.0, width: int = 7) -> DataFrame:
    """Fixed two-hour corrections, smoothed around the clock."""
    seg = (F.floor((F.col("block") - 1) / 8) * 8 + 1).cast("int")
    m = F.create_map(*[F.lit(x) for kv in T2_SEGMENT_MW.items() for x in kv])
    return circular_smooth(full_blocks(df).withColumn("raw", F.element_at(m, seg) * blend), "raw", width, ["state"], "correction")


def add_table(df: DataFrame, table: DataFrame, column: str = "correction") -> DataFrame:
    j = df.join(table.select("state", "block", column), ["state", "block"], "left")
    return j.withColumn("corrected", nonneg(F.col("forecast") + F.coalesce(column, zero())))


def t2_level(t1: DataFrame, t2: DataFrame, blend: float = 0.30, cap: float = 1.05, night_floor: float = 100.0, mid_floor: float = 500.0) -> DataFrame:
    """Scale T+2 up (never down) by the T+1 / T+2 ratio of the night, mixed 70 / 30 with that of midday.

    ``t1`` rows carry the date of T+1; T+2 is the following day.
    """
    b, f = F.col("block"), F.col("forecast")
    def means(d: DataFrame, p: str) -> DataFrame:
        return d.groupBy(*DAY).agg(avg_where((b <= 24) & (f > 0), f).alias(f"{p}n"), avg_where(b.between(41, 48) & (f > 0), f).alias(f"{p}m"))
    m = means(t2, "b").join(means(t1, "a").withColumn("date", F.date_add("date", 1)), DAY, "left")
    night = F.col("an") / F.col("bn")
    mixed = F.when((F.col("am") > mid_floor) & (F.col("bm") > mid_floor), 0.7 * night + 0.3 * F.col("am") / F.col("bm")).otherwise(night)
    r = F.when((F.col("an") > night_floor) & (F.col("bn") > night_floor) & (mixed > 1), F.least(mixed, F.lit(cap))).otherwise(1.0)
    j = t2.join(m.select(*DAY, F.coalesce(r, F.lit(1.0)).alias("level_ratio")), DAY)
    return j.withColumn("normalised", (1 - blend) * f + blend * f * F.col("level_ratio"))


def t2_night_anchor(t2: DataFrame, t1: DataFrame, tail: int = 4, decay: float = 16.0, floor: float = 10.0, min_bias: float = 5.0) -> DataFrame:
    """Carry the mean error of T+1's last settled blocks into T+2 with exponential decay."""
    ok = (F.col("block") > 96 - tail) & (F.col("actual") > floor) & (F.col("forecast") > floor)
    e = t1.groupBy(*DAY).agg(avg_where(ok, F.col("actual") - F.col("forecast")).alias("_b"), count_where(ok).alias("_n")).withColumn("date", F.date_add("date", 1))
    j = t2.join(e, DAY, "left")
    use = (F.col("_n") >= 2) & (F.abs("_b") >= min_bias)
    add = F.when(use, F.col("_b") * F.exp(-(F.col("block") - 1) / decay)).otherwise(0.0)
    return j.withColumn("carried", add).withColumn("anchored", F.when(use, nonneg(F.col("forecast") + add)).otherwise(F.col("forecast"))).drop("_b", "_n")


def seam_anchor(t1: DataFrame, load: DataFrame, tail: int = 4, share: float = 0.6) -> DataFrame:
    """Level at the end of T+1: exponential weights over its last blocks of 60 % lag-7 actual and 40 % forecast."""
    lag = load.select("state", F.date_add("date", 7).alias("date"), "block", F.col("load").alias("_l7"))
    j = t1.where(F.col("block") > 96 - tail).join(lag, [*DAY, "block"], "left")
    v = F.when(F.col("_l7").isNotNull(), share * F.col("_l7") + (1 - share) * F.col("forecast")).otherwise(F.col("forecast"))
    w = F.exp((F.col("block") - (96 - tail) - 1) / float(tail - 1))
    return j.groupBy(*DAY).agg((F.sum(v * w) / F.sum(w)).alias("anchor"))


def seam(df: DataFrame, anchors: DataFrame, window: int = 8) -> DataFrame:
    """Cosine bridge from the anchor level of the day before into the first blocks. ``anchors``: state, date of the day before, anchor."""
    a = anchors.select("state", F.date_add("date", 1).alias("date"), "anchor")
    first = df.groupBy(*DAY).agg(F.max(F.when(F.col("block") == 1, F.col("forecast"))).alias("_f1"))
    j = df.join(first.join(a, DAY, "left"), DAY, "left")
    w = F.when(F.col("block") <= window, 0.5 * (1 + F.cos(math.pi * (F.col("block") - 1) / float(window - 1)))).otherwise(0.0)
    j = j.withColumn("gap_before", F.col("_f1") - F.col("anchor"))
    return j.withColumn("bridged", F.col("forecast") + F.coalesce((F.col("anchor") - F.col("_f1")) * w, zero())).drop("_f1")


def base_seam(df: DataFrame, load: DataFrame, window: int = 6) -> DataFrame:
    """Linear bridge from the last actual block of the day before; the step at the seam is limited to 5 % or 25 MW."""
    last = load.where(F.col("block") == 96).select("state", F.date_add("date", 1).alias("date"), F.col("load").alias("_p"))
    first = df.groupBy(*DAY).agg(F.max(F.when(F.col("block") == 1, F.col("forecast"))).alias("_f1")).join(last, DAY, "left")
    step = F.greatest(0.05 * F.greatest("_p", "_f1", F.lit(1.0)), F.lit(25.0))
    target = F.when(F.col("_f1").isNotNull() & F.col("_p").isNotNull(), F.col("_p") + F.least(F.greatest(F.col("_f1") - F.col("_p"), -step), step))
    j = df.join(first.withColumn("_t", target), DAY, "left")
    w = F.col("block") / float(window + 1)
    return j.withColumn("bridged", F.when((F.col("block") <= window) & F.col("_t").isNotNull(), (1 - w) * F.col("_t") + w * F.col("forecast")).otherwise(F.col("forecast"))).drop("_p", "_f1", "_t")


# --- same-day corrections -------------------------------------------------------------------------------------------


def residual_bias(df: DataFrame, date: str, outages: DataFrame, fast: int = 5, slow: int = 60, feature: str = "load") -> DataFrame:
    """0.4 x fast + 0.1 x slow mean residual against the trailing week per block; the fast part is clipped at 3 MAD."""
    r = df.where(F.col("date") < F.lit(date).cast("date")).withColumn("resid", F.col(feature) - F.avg(feature).over(days_ago(SB, 7, 1))).where("resid is not null")
    r = r.join(outages.where("outage").select(*DAY), DAY, "left_anti")
    days = r.select(*DAY).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= slow)
    r = r.join(days, DAY)
    med = r.groupBy("state").agg(F.median("resid").alias("_m"))
    mad = r.join(med, "state").groupBy("state").agg(F.median(F.abs(F.col("resid") - F.col("_m"))).alias("_mad"))
    b = r.groupBy("state", "block").agg(F.coalesce(avg_where(F.col("_r") <= fast, "resid"), zero()).alias("_f"), F.avg("resid").alias("slow"))
    b = b.join(mad, "state")
    lim = 3.0 * F.col("_mad")
    b = b.withColumn("fast", F.when(F.col("_mad") > 0, F.least(F.greatest("_f", -lim), lim)).otherwise(F.col("_f")))
    return b.select("state", "block", "fast", "slow", (0.4 * F.col("fast") + 0.1 * F.col("slow")).alias("bias"))


def partial_day(df: DataFrame, settled: int, max_pct: float = 0.08) -> DataFrame:
    """Linear trend of the settled blocks' relative errors (outliers beyond 3 MAD dropped), continued over the rest of the day."""
    b = F.col("block")
    e = df.where((b <= settled) & F.col("actual").isNotNull() & (F.abs("forecast") > 1e-6)).select(
        *DAY, b.cast("double").alias("block"), clip((F.col("actual") - F.col("forecast")) / F.abs("forecast"), -0.2, 0.2).alias("err"))
    m = e.groupBy(*DAY).agg(F.median("err").alias("_m"), F.count("err").alias("_n"))
    e = e.join(m, DAY)
    e = e.join(e.groupBy(*DAY).agg(F.median(F.abs(F.col("err") - F.col("_m"))).alias("_mad")), DAY)
    e = e.withColumn("_keep", F.abs(F.col("err") - F.col("_m")) <= F.greatest(F.lit(0.02), 3.0 * F.col("_mad")))
    e = e.join(e.groupBy(*DAY).agg(count_where(F.col("_keep")).alias("_k")), DAY).where((F.col("_k") < 4) | F.col("_keep"))
    fit = e.groupBy(*DAY).agg(slope("err", "block").alias("_s"), intercept("err", "block").alias("_i"), F.avg("err").alias("_avg"), F.count("err").alias("fit_points"), F.max("_n").alias("_n"))
    use = F.col("fit_points") >= 6
    fit = fit.select(*DAY, "fit_points", "_n", F.when(use, F.coalesce("_s", zero())).otherwise(0.0).alias("slope"), F.when(use, F.coalesce("_i", "_avg")).otherwise(F.col("_avg")).alias("intercept"))
    j = df.join(fit, DAY, "left")
    gain = F.least(F.greatest(F.col("fit_points") / 48.0, F.lit(0.25)), F.lit(1.0))
    k = b - settled
    ramp = F.when(k <= 4, 0.25 + 0.25 * (k - 1)).otherwise(1.0)
    pct = F.least(F.greatest((F.col("intercept") + F.col("slope") * b) * gain, F.lit(-max_pct)), F.lit(max_pct)) * ramp
    ok = (b > settled) & F.lit(settled >= 8) & (F.col("_n") >= 6)
    return j.withColumn("corr_pct", F.when(ok, pct).otherwise(0.0)).withColumn("corrected", F.when(ok, nonneg(F.col("forecast") * (1 + F.col("corr_pct")))).otherwise(F.col("forecast"))).drop("_n")


def intraday_recalibrate(df: DataFrame, settled: int, min_mape: float = 2.0, floor: float = 10.0) -> DataFrame:
    """Mean error of the settled blocks spread over the rest of the day with a linear taper, if they are off by 2 % or more."""
    b = F.col("block")
    ok = (b <= settled) & (F.col("actual") > floor) & (F.col("forecast") > floor)
    e = df.groupBy(*DAY).agg(avg_where(ok, F.col("actual") - F.col("forecast")).alias("bias"), count_where(ok).alias("_n"),
                             (avg_where(ok, F.abs(F.col("actual") - F.col("forecast")) / F.greatest("actual", F.lit(1.0))) * 100).alias("mape"))
    j = df.join(e, DAY)
    taper = 1.0 - (b - settled - 1) / float(max(96 - settled - 1, 1))
    use = F.lit(8 <= settled < 96) & (F.col("_n") >= 4) & (F.col("mape") >= min_mape)
    return j.withColumn("recalibrated", F.when(use, nonneg(F.col("forecast") + F.when(b > settled, F.col("bias") * taper).otherwise(0.0))).otherwise(F.col("forecast"))).drop("_n")


def stitch(df: DataFrame, settled: int, taper: int = 8) -> DataFrame:
    """Actuals up to the settled block, then a cosine ease from the last actual into the forecast."""
    b = F.col("block")
    last = df.groupBy(*DAY).agg(F.max_by("actual", F.when((b <= settled) & F.col("actual").isNotNull(), b)).alias("_a"))
    n = min(taper, 96 - settled)
    k = b - settled
    w = 0.5 * (1 - F.cos(math.pi * k / float(n + 1)))
    mixed = F.when(F.col("_a").isNotNull() & k.between(1, n), F.col("_a") * (1 - w) + F.col("forecast") * w).otherwise(F.col("forecast"))
    return df.join(last, DAY).withColumn("stitched", F.when((b <= settled) & F.col("actual").isNotNull(), F.col("actual")).otherwise(mixed)).drop("_a")


def live_ratio(df: DataFrame, settled: int, recent: int = 24, alpha: float = 0.5, lo: float = 0.95, hi: float = 1.05, fc_floor: float = 100.0, act_floor: float = 50.0) -> DataFrame:
    """Clipped moving average of actual / forecast over the last settled blocks, applied to the rest of the day."""
    b = F.col("block")
    ok = b.between(settled - recent + 1, settled) & (F.col("forecast") > fc_floor) & (F.col("actual") > act_floor)
    r = df.where(ok).withColumn("_r", F.col("actual") / F.col("forecast"))
    n = r.groupBy(*DAY).agg(F.count("_r").alias("_n"))
    e = ema_of_day(r, "_r", alpha).join(n, DAY).select(*DAY, F.when((F.col("_n") >= 3) & F.lit(settled >= 4), clip("ema", lo, hi)).otherwise(1.0).alias("live_ratio"))
    j = df.join(e, DAY, "left").withColumn("live_ratio", F.coalesce("live_ratio", F.lit(1.0)))
    return j.withColumn("calibrated", F.when(b > settled, nonneg(F.col("forecast") * F.col("live_ratio"))).otherwise(F.col("forecast")))


def anchor_mix(load: DataFrame, date: str, horizon: int = 1, min_blocks: int = 96) -> DataFrame:
    """Diagnostic anchor of the horizon calibration: weighted mix of the last day, last 3, last 7 and last 4 same weekdays."""
    d = F.lit(date).cast("date")
    day = load.where(F.col("date") < d).groupBy(*DAY).agg(F.count("load").alias("_n")).where(F.col("_n") >= min_blocks)
    o = Window.partitionBy("state").orderBy(F.desc("date"))
    day = day.withColumn("_r", F.row_number().over(o)).where(F.col("_r") <= 45)
    same = F.weekday("date") == F.weekday(d)
    day = day.withColumn("_s", F.when(same, F.sum(F.when(same, 1).otherwise(0)).over(o.rowsBetween(Window.unboundedPreceding, 0))))
    b = load.join(day.select(*DAY, "_r", "_s"), DAY).groupBy("state", "block").agg(
        avg_where(F.col("_r") == 1, "load").alias("last"), avg_where(F.col("_r") <= 3, "load").alias("last3"), avg_where(F.col("_r") <= 7, "load").alias("last7"), avg_where(F.col("_s") <= 4, "load").alias("same"))
    same_c = F.coalesce("same", "last7")
    if horizon == 1:
        mix = 0.4 * F.col("last") + 0.3 * F.col("last3") + 0.3 * same_c
    else:
        w = F.when(F.weekday(d).isin(0, 6), 0.3).otherwise(0.4)
        mix = 0.3 * F.col("last") + 0.3 * F.col("last3") + w * same_c + (0.4 - w) * F.col("last7")
    return b.withColumn("anchor", mix)


def shrink_to_baseline(df: DataFrame, baseline: str, history: DataFrame, settled: int = 0, offpeak: float = 0.50, peak: float = 0.25, bonus: float = 0.20,
                       peak_blocks: tuple[int, int] = (48, 72), window: int = 14, feature: str = "actual") -> DataFrame:
    """Pull toward the baseline: fixed weights in and out of the peak window, lowered where the block was volatile lately."""
    b = F.col("block")
    inside = b.between(*peak_blocks)
    w = F.when(inside, peak).otherwise(offpeak)
    if settled:
        w = F.least(F.greatest(w + bonus * settled / 96.0, zero()), F.lit(1.0))
    hw = days_ago(SB, window, 1)
    vol = history.select(*DAY, "block", ratio(F.stddev_samp(feature).over(hw), F.greatest(F.avg(feature).over(hw), F.lit(1.0))).alias("_v"))
    j = df.join(vol, [*DAY, "block"], "left")
    dyn = F.least(F.greatest(0.98 - F.coalesce("_v", zero()) * 3.0, F.lit(0.80)), F.lit(0.98))
    dyn = F.when(inside, F.least(F.greatest(dyn + 0.05, F.lit(0.80)), F.lit(0.98))).otherwise(dyn)
    wt = F.when(b <= settled, 1.0).otherwise(F.least(w, dyn))
    return j.withColumn("weight", wt).withColumn("shrunk", F.col("weight") * F.col("forecast") + (1 - F.col("weight")) * F.coalesce(baseline, "forecast")).drop("_v")


def momentum_carry(df: DataFrame, settled: int, decay: float = 8.0, cap_pct: float = 0.03, cap_floor: float = 75.0) -> DataFrame:
    """Change over the last hour of actuals carried forward with exponential decay, within 3 % (at least 75 MW)."""
    b = F.col("block")
    m = df.groupBy(*DAY).agg((F.max(F.when(b == settled, F.col("actual"))) - F.max(F.when(b == settled - 4, F.col("actual")))).alias("momentum"))
    j = df.join(m, DAY)
    cap = F.greatest(cap_pct * F.greatest("forecast", F.lit(1.0)), F.lit(cap_floor))
    adj = F.when((b > settled) & F.lit(settled >= 5), F.least(F.greatest(F.coalesce("momentum", zero()) * F.exp(-(b - settled) / decay), -cap), cap)).otherwise(0.0)
    return j.withColumn("carry", adj).withColumn("carried", nonneg(F.col("forecast") + adj))


def diurnal_shape(df: DataFrame, load: DataFrame, settled: int, n_days: int = 8, limit: float = 0.2) -> DataFrame:
    """Correct the forecast's ratio to its morning mean toward that of the last same-type days, within +-20 %.

    Day-level means are offered to the following days on record of the same type, so every target date is served by
    one aggregation; only the chosen days' block ratios are averaged.
    """
    day = load.groupBy(*DAY).agg(avg_where(F.col("block") <= settled, "load").alias("_mm")).where(F.col("_mm") > 0).withColumn("_we", F.weekday("date") >= 5)
    i = F.row_number().over(Window.partitionBy("state", "_we").orderBy("date"))
    day = day.withColumn("_i", i)
    targets = df.select(*DAY).distinct().withColumn("_we", F.weekday("date") >= 5)
    # position of each target among the same-type history days that precede it
    both = day.select("state", "date", "_we", F.lit(1).alias("_h")).unionByName(targets.withColumn("_h", F.lit(0)).select("state", "date", "_we", "_h"))
    pos = F.sum("_h").over(Window.partitionBy("state", "_we").orderBy("date", F.desc("_h")).rowsBetween(Window.unboundedPreceding, 0))
    pos = both.withColumn("_p", pos).where("_h = 0").join(day.select("state", "date", F.lit(1).alias("_own")), DAY, "left")
    pos = pos.withColumn("_p", F.col("_p") - F.coalesce("_own", F.lit(0)))
    pick = pos.where(F.col("_p") >= 3).select("state", "date", "_we", F.explode(F.sequence(F.greatest(F.col("_p") - n_days + 1, F.lit(1)), F.col("_p"))).alias("_i"))
    pick = pick.join(day.select("state", "_we", "_i", F.col("date").alias("_d"), "_mm"), ["state", "_we", "_i"])
    h = pick.join(load.select("state", F.col("date").alias("_d"), "block", "load"), ["state", "_d"]).groupBy(*DAY, "block").agg(F.avg(F.col("load") / F.col("_mm")).alias("_hs"))
    m = df.groupBy(*DAY).agg(avg_where(F.col("block") <= settled, "forecast").alias("_fm"))
    j = df.join(h, [*DAY, "block"], "left").join(m, DAY)
    raw = F.when((F.col("forecast") > 0) & F.col("_hs").isNotNull() & (F.col("block") > settled), F.col("_hs") / (F.col("forecast") / F.col("_fm"))).otherwise(1.0)
    mult = F.coalesce(clip(raw, 1 - limit, 1 + limit), F.lit(1.0)) if settled >= 4 else F.lit(1.0)
    return j.withColumn("multiplier", mult).withColumn("shaped", F.col("forecast") * F.col("multiplier")).drop("_hs", "_fm")


def calendar_factor(df: DataFrame, daily: DataFrame) -> DataFrame:
    """Multiplier of the day's calendar position per block. ``df`` has the transition flags of its date; ``daily``: state, date, total.

    Weekend and holiday ratios come from the daily totals of the state.
    """
    r = daily.groupBy("state").agg(ratio(avg_where(F.weekday("date") >= 5, "total"), avg_where(F.weekday("date") < 5, "total")).alias("_w"))
    j = df.join(r, "state", "left").withColumn("_w", F.coalesce("_w", F.lit(0.92)))
    b, one = F.col("block"), lambda c: F.col(c) == 1
    hol = F.least(F.col("_w"), F.lit(0.92))
    total = (F.when(one("is_holiday"), hol * F.when(one("holiday_before_weekend") & b.between(69, 88), 0.95).otherwise(1.0))
             .when(one("bridge_day"), 0.5 * hol + 0.5).when(one("long_weekend"), F.col("_w") * 0.97)
             .when(F.col("days_to_holiday") == 1, F.when(b.between(73, 96), 0.97).otherwise(1.0))
             .when(F.col("days_since_holiday") == 1, F.when(b.between(21, 44), 0.96 + 0.04 * (b - 21) / 23.0).otherwise(1.0)).otherwise(1.0))
    transition = F.when(one("is_holiday") & one("holiday_after_weekend") & b.between(21, 40), hol + (1 - hol) * (b - 21) / 19.0).otherwise(1.0)
    return j.withColumn("factor", total).withColumn("transition", transition).drop("_w")


# --- behaviour ------------------------------------------------------------------------------------------------------

# Behaviour windows (climate region, season, day type, label, first block, last block, MW).
BEHAVIOUR_ROWS = """
('north', 'summer', 'Weekday', 'AC + Industrial peak', 37, 72, 200.0), ('north', 'summer', 'Weekday', 'Evening cooking & lighting', 73, 84, 150.0),
('north', 'summer', 'Weekday', 'Late-night cool-down', 1, 20, -80.0), ('north', 'summer', 'Weekend', 'Residential AC (late start)', 41, 76, 250.0),
('north', 'summer', 'Weekend', 'Evening leisure', 77, 88, 120.0), ('north', 'summer', 'Weekend', 'Night rest', 1, 24, -60.0),
('north', 'winter', 'Weekday', 'Morning heating demand', 21, 36, 200.0), ('north', 'winter', 'Weekday', 'Evening heating + lighting', 69, 84, 280.0),
('north', 'winter', 'Weekday', 'Midday mild', 41, 60, -40.0), ('north', 'winter', 'Weekend', 'Late morning heating', 25, 40, 220.0),
('north', 'winter', 'Weekend', 'Evening heating + cooking', 73, 88, 250.0), ('north', 'winter', 'Weekend', 'Night base', 1, 20, -30.0),
('north', 'spring', 'Weekday', 'Morning ramp', 29, 44, 80.0), ('north', 'spring', 'Weekday', 'Afternoon moderate', 49, 64, 60.0), ('north', 'spring', 'Weekday', 'Evening cooking', 73, 84, 90.0)
"""


def behaviour_adjustment(profiles: DataFrame, weight: float = 1.0) -> DataFrame:
    """MW per (region, season, day type, block): Gaussian windows on the circular block distance, smoothed.

    ``profiles``: region, season, day_type, label, b_start, b_end, mw (a dimension table of a few hundred rows).
    """
    k = ["region", "season", "day_type"]
    p = profiles.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(96))))
    centre, half = (F.col("b_start") + F.col("b_end")) / 2.0, (F.col("b_end") - F.col("b_start")) / 2.0
    sigma = F.greatest(half / 2.5, F.lit(2.0))
    gap = F.abs(F.col("block") - centre)
    dist = F.least(gap, 96.0 - gap)
    a = p.groupBy(*k, "block").agg((F.sum(F.col("mw") * F.exp(-0.5 * F.pow(dist / sigma, F.lit(2.0)))) * weight).alias("raw"))
    return circular_smooth(a, "raw", 5, k, "adjustment")


def with_behaviour(df: DataFrame, profiles: DataFrame) -> DataFrame:
    """``adjustment`` of each row of (region, season, day_type, block): its own profile, else that of Weekday or Weekend, else 0.

    Rows need a date besides; every row stays, and a region's profile is never given to another region.
    """
    k = ["region", "season", "day_type", "block"]
    broad = F.when(F.weekday("date") >= 5, "Weekend").otherwise("Weekday")
    own = profiles.select(*k, F.col("adjustment").alias("_own"))
    fallback = profiles.select("region", "season", F.col("day_type").alias("_broad"), "block", F.col("adjustment").alias("_fallback"))
    j = df.withColumn("_broad", broad).join(own, k, "left").join(fallback, ["region", "season", "_broad", "block"], "left")
    return j.withColumn("adjustment", F.coalesce("_own", "_fallback", F.lit(0.0))).drop("_own", "_fallback", "_broad")


def behaviour_residuals(df: DataFrame, feature: str = "load") -> DataFrame:
    """Recency-weighted mean residual against the trailing week per (state, season, day type, block)."""
    w = days_ago(SB, 7, 1)
    r = df.withColumn("resid", F.when(F.count(feature).over(w) >= 3, F.col(feature) - F.avg(feature).over(w))).where("resid is not null")
    r = join_stats(r, ["state"], _last=F.max("date"))
    return r.groupBy("state", "season", "day_type", "block").agg(recency_weighted("resid", F.datediff("_last", "date")).alias("profile"), F.count("resid").alias("n"))


def behaviour_fourier(df: DataFrame, harmonics: int = 4, feature: str = "load", min_rows: int = 12) -> DataFrame:
    """Weighted Fourier fit of the residual over the day, from weighted cross products solved per (state, season, day type)."""
    from quarterhour.operators.regress import cross_products, solve_ridge
    w = days_ago(SB, 7, 1)
    r = df.withColumn("resid", F.when(F.count(feature).over(w) >= 3, F.col(feature) - F.avg(feature).over(w))).where("resid is not null")
    r = join_stats(r, ["state"], _last=F.max("date"))
    angle = 2.0 * math.pi * (F.col("block") - 1) / 96.0
    xs = []
    for h in range(1, harmonics + 1):
        r = r.withColumn(f"s{h}", F.sin(h * angle)).withColumn(f"c{h}", F.cos(h * angle))
        xs += [f"s{h}", f"c{h}"]
    k = ["state", "season", "day_type"]
    p = cross_products(r, "resid", xs, k, weight=F.exp(-0.693 * F.datediff("_last", "date") / 21.0))
    b = solve_ridge(p, xs, k, min_rows=1)
    b = b.withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(96))))
    angle = 2.0 * math.pi * (F.col("block") - 1) / 96.0
    fit = F.col("intercept")
    for h in range(1, harmonics + 1):
        fit = fit + F.col(f"beta_s{h}") * F.sin(h * angle) + F.col(f"beta_c{h}") * F.cos(h * angle)
    return b.select(*k, "block", fit.alias("curve"))


def blended_behaviour(residuals: DataFrame, curve: DataFrame, peaks: DataFrame, blend: float = 0.55, smooth: int = 5) -> DataFrame:
    """Fourier curve and empirical profile mixed, smoothed around the clock, clipped at 8 % of the state's high load.

    ``peaks``: state, p95.
    """
    k = ["state", "season", "day_type"]
    j = curve.join(residuals.select(*k, "block", "profile"), [*k, "block"], "left")
    j = interpolate(j, "profile", k, "block").withColumn("mixed", blend * F.col("curve") + (1 - blend) * F.col("profile"))
    j = circular_smooth(j, "mixed", smooth, k, "smoothed").join(peaks, "state")
    lim = F.greatest(0.08 * F.col("p95"), F.lit(150.0))
    return j.withColumn("adjustment", F.least(F.greatest("smoothed", -lim), lim)).drop("p95")


# --- weather-driven -------------------------------------------------------------------------------------------------


def afternoon_ramp(df: DataFrame, baseline: str, hot_season: Column, wind_jump: DataFrame | None = None) -> DataFrame:
    """Afternoon heat adjustment in percent of the baseline by regime, cold adjustment, damped when wind jumped.

    ``wind_jump``: state, date, wind_delta (daily maximum against the trailing week).
    """
    t, h = F.coalesce("temperature", F.lit(25.0)), F.coalesce("humidity", F.lit(50.0))
    hour = F.floor((F.col("block") - 1) / 4)
    j = df.join(weather_regime(df).select(*DAY, "regime"), DAY)
    excess = F.greatest(zero(), t - 38.0)
    boost = F.least(F.lit(1.6), 1.0 + 0.04 * excess) * (1.0 + 0.3 * F.sin(math.pi * F.least(F.greatest((hour - 13) / 4.0, zero()), F.lit(1.0))))
    noon = hot_season & hour.between(13, 17)
    mult = F.when(noon, boost).when(hot_season & hour.between(10, 12), 1.15).otherwise(1.0)
    lim = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    base = (F.when(F.col("regime") == "PRE_MONSOON_HOT", lim((mult - 1) * 0.055, 0.0, 0.08)).when(F.col("regime") == "DUSTY", -0.04).when(F.col("regime") == "RAINY", -0.025)
            .otherwise(lim((mult - 1) * 0.025, 0.0, 0.035)))
    heat = lim(F.pow(F.greatest(zero(), t - 24.0), F.lit(1.5)) / 120.0 + (t * (1.0 + h / 100.0) - 36.0) / 1200.0, 0.0, 0.035)
    pct = F.when(noon, lim(base + heat, -0.05, 0.10)).otherwise(0.0)
    cold = F.pow(F.greatest(zero(), 18.0 - t), F.lit(1.3)) / 180.0
    pct = F.when(t <= 18.0, lim(pct + cold, -0.05, 0.06)).otherwise(pct)
    if wind_jump is not None:
        j = j.join(wind_jump, DAY, "left")
        d = F.coalesce("wind_delta", zero())
        pct = pct * F.when(d > 8.0, F.greatest(F.lit(0.88), 1.0 - (d - 8.0) * 0.015)).otherwise(1.0)
    return j.withColumn("multiplier", mult).withColumn("adjust_pct", pct).withColumn("adjust_mw", F.col(baseline) * F.col("adjust_pct")).withColumn("heat_index", heat_index_polynomial(t, h))


def wind_shedding(df: DataFrame, forecast: str, threshold: float = 65.0, hub_factor: float = 1.4, cap: float = 600.0) -> DataFrame:
    """Flat cut on days whose hub-height wind (1.4 x surface) reaches the feeder-protection threshold."""
    d = df.groupBy(*DAY).agg((F.max("wind_speed_10m") * hub_factor).alias("hub_wind"))
    cut = F.when(F.col("hub_wind") >= threshold, F.least(30.0 * F.log1p((F.col("hub_wind") - threshold) / 10.0) * 10.0, F.lit(cap))).otherwise(0.0)
    j = df.join(d.withColumn("shed_mw", F.coalesce(cut, zero())), DAY)
    return j.withColumn("after_shedding", nonneg(F.col(forecast) - F.col("shed_mw")))


def seed_error(df: DataFrame, settled: int, decay: float = 0.997, lookback: int = 28) -> DataFrame:
    """Weighted error of the last settled blocks carried forward as seed x decay^k; the value at block 96 seeds T+2."""
    b = F.col("block")
    e = F.when(b.between(max(settled - lookback, 0) + 1, settled), F.col("actual") - F.col("forecast"))
    w = F.pow(F.lit(decay), settled - b)
    s = df.groupBy(*DAY).agg(F.try_divide(F.sum(e * w), F.sum(F.when(e.isNotNull(), w))).alias("seed"))
    j = df.join(s, DAY)
    add = F.when(b > settled, F.coalesce("seed", zero()) * F.pow(F.lit(decay), b - settled)).otherwise(0.0)
    return j.withColumn("carried_error", add).withColumn("corrected", F.when((b <= settled) & F.col("actual").isNotNull(), F.col("actual")).otherwise(F.col("forecast") + add))


def seed_into_t2(t2: DataFrame, t1: DataFrame, settled: int, decay: float = 0.997) -> DataFrame:
    """Continue the T+1 seed error into T+2 when it still exceeds 1 MW at the end of T+1."""
    s = seed_error(t1, settled, decay).where("block = 96").select("state", F.date_add("date", 1).alias("date"), F.col("carried_error").alias("_end"))
    j = t2.join(s, DAY, "left")
    add = F.when(F.abs("_end") > 1.0, F.col("_end") * F.pow(F.lit(decay), F.col("block"))).otherwise(0.0)
    return j.withColumn("corrected", F.when(F.abs("_end") > 1.0, nonneg(F.col("forecast") + add)).otherwise(F.col("forecast"))).drop("_end")


def lagged_pair(df: DataFrame, k: int = 7, feature: str = "load") -> DataFrame:
    """Actual beside the lag-k forecast."""
    return df.select(*DAY, "block", F.col(feature).alias("actual"), day_lag(feature, k).alias("forecast")).where("forecast is not null")
