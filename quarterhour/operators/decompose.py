"""Decompositions and smoothing over the daily and the block series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour import BLOCKS_PER_DAY
from quarterhour.functions.blocks import day_number
from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import intercept, slope
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import interpolate


def rolling_where(fn: Column, window, count_of: str, min_rows: int) -> Column:
    """Rolling aggregate that needs a minimum number of values in its window."""
    return F.when(F.count(count_of).over(window) >= min_rows, fn.over(window))


def hourly_bands(df: DataFrame, days: int = 7, feature: str = "load") -> DataFrame:
    """Hourly means, gaps interpolated, trailing mean and spread over ``days`` days, +-2 sigma bands and deviation.

    The hourly calendar of a state is dense and bounded (24 rows a day); bands need a full window.
    """
    h = df.groupBy("state", "date", "hour").agg(F.avg(feature).alias("x"))
    span = h.groupBy("state").agg(F.min(day_number("date") * 24 + F.col("hour")).alias("_lo"), F.max(day_number("date") * 24 + F.col("hour")).alias("_hi"))
    grid = span.select("state", F.explode(F.sequence("_lo", "_hi")).alias("hn"))
    g = grid.join(h.select("state", (day_number("date") * 24 + F.col("hour")).alias("hn"), "x"), ["state", "hn"], "left")
    g = interpolate(g, "x", ["state"], "hn")
    w = Window.partitionBy("state").orderBy("hn").rowsBetween(-(days * 24 - 1), 0)
    g = g.withColumn("mean", rolling_where(F.avg("x"), w, "x", days * 24)).withColumn("std", rolling_where(F.stddev_samp("x"), w, "x", days * 24))
    return g.select("state", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("hn") / 24).cast("int")).alias("date"),
                    F.pmod("hn", F.lit(24)).cast("int").alias("hour"), "x", "mean", "std", (F.col("mean") + 2 * F.col("std")).alias("upper"),
                    (F.col("mean") - 2 * F.col("std")).alias("lower"), (F.col("x") - F.col("mean")).alias("deviation"))


def daily_seasonal(df: DataFrame, feature: str = "load") -> DataFrame:
    """Centred 7-day trend, weekday pattern of what is left, residual; edges without a full window stay NULL."""
    d = df.groupBy("state", "date").agg(F.avg(feature).alias("value"))
    w = Window.partitionBy("state").orderBy("date").rowsBetween(-3, 3)
    d = d.withColumn("trend", rolling_where(F.avg("value"), w, "value", 7)).withColumn("detrended", F.col("value") - F.col("trend")).withColumn("dow", F.weekday("date"))
    d = join_stats(d, ["state", "dow"], seasonal=F.avg("detrended"))
    return d.withColumn("residual", F.col("detrended") - F.col("seasonal"))


def layers(df: DataFrame, feature: str = "load") -> DataFrame:
    """Seasonal (weekday x block mean), weather (temperature regression of what is left) and residual parts per row."""
    d = join_stats(df, ["state", "dow", "block"], seasonal=F.avg(feature))
    d = d.withColumn("_y", F.col(feature) - F.col("seasonal"))
    d = join_stats(d, ["state"], _b=slope("_y", "temperature"), _a=intercept("_y", "temperature"), _tm=F.avg("temperature"), _n=F.count("temperature"))
    fit = F.col("_a") + F.col("_b") * F.coalesce("temperature", "_tm")
    d = d.withColumn("weather", F.when(F.col("_n") > 20, F.coalesce(fit, F.lit(0.0))).otherwise(0.0))
    return d.withColumn("residual", F.col("_y") - F.col("weather")).drop("_y", "_a", "_b", "_tm", "_n")


def contribution(df: DataFrame, feature: str = "load") -> DataFrame:
    """Share of each layer in the total absolute size."""
    d = layers(df, feature)
    parts = ("seasonal", "weather", "residual")
    s = d.groupBy("state").agg(*[F.sum(F.abs(p)).alias(p) for p in parts])
    total = F.col("seasonal") + F.col("weather") + F.col("residual")
    return s.select("state", *[(ratio(p, total) * 100).alias(f"{p}_pct") for p in parts])


def circular_smooth(df: DataFrame, value: str, width: int, keys: Sequence[str], out: str | None = None) -> DataFrame:
    """Centred mean over ``width`` blocks that wraps midnight. One row per (keys, block), at most 96 rows a group.

    Each row is handed to the blocks it contributes to, so the smoothing is one more partial aggregation.
    """
    half = width // 2
    offs = F.array(*[F.lit(k) for k in range(-half, half + 1)])
    target = (F.pmod(F.col("block") + F.col("_k") - 1, F.lit(BLOCKS_PER_DAY)) + 1).cast("int")
    spread = df.select(*keys, "block", value, F.explode(offs).alias("_k")).select(*keys, target.alias("block"), F.col(value).alias("_v"))
    sm = spread.groupBy(*keys, "block").agg(F.avg("_v").alias(out or f"{value}_smooth"))
    return df.join(sm, [*keys, "block"], "left")


def edge_padded_smooth(value: str, width: int, keys: Sequence[str]) -> Column:
    """Mean over ``width`` blocks (half of them before the row); beyond the ends the first and last values repeat."""
    left, right = width // 2, width - 1 - width // 2
    w = Window.partitionBy(*keys).orderBy("block")
    frame = w.rowsBetween(-left, right)
    n = F.count(F.lit(1)).over(frame)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.first(value).over(Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0))
    head = F.greatest(F.lit(left) - (F.row_number().over(w) - 1), F.lit(0))
    return (F.sum(value).over(frame) + head * first + (width - n - head) * last) / width


# Savitzky-Golay coefficients for a 5-point quadratic fit.
SAVGOL_5_2 = (-3.0, 12.0, 17.0, 12.0, -3.0)


def savgol(value: str, keys: Sequence[str], raw_share: float = 0.8) -> Column:
    """Raw value blended with its 5-point quadratic smooth (ends repeat, never negative)."""
    w = Window.partitionBy(*keys).orderBy("block")
    up, dn = lambda k: F.lag(value, k).over(w), lambda k: F.lead(value, k).over(w)
    v = F.col(value)
    l1, r1 = F.coalesce(up(1), v), F.coalesce(dn(1), v)
    l2, r2 = F.coalesce(up(2), l1), F.coalesce(dn(2), r1)
    c = SAVGOL_5_2
    smooth = (c[0] * l2 + c[1] * l1 + c[2] * v + c[3] * r1 + c[4] * r2) / 35.0
    return raw_share * v + (1 - raw_share) * F.greatest(smooth, F.lit(0.0))


def median3(value: str, keys: Sequence[str]) -> Column:
    """Middle of the value and its two neighbours; the ends compare with zero padding replaced by themselves."""
    w = Window.partitionBy(*keys).orderBy("block")
    v = F.col(value)
    trio = F.array_sort(F.array(F.coalesce(F.lag(value).over(w), v), v, F.coalesce(F.lead(value).over(w), v)))
    return F.element_at(trio, 2)


def recency_weighted(value: Column | str, age_days: Column, half_life: float = 21.0) -> Column:
    """Mean weighted by exponential recency (0.693 / half life per day)."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.exp(-0.693 * age_days / half_life)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def ema_of_day(df: DataFrame, value: str, alpha: float = 0.5, keys: Sequence[str] = ("state", "date")) -> DataFrame:
    """Exponential moving average over a day's blocks in order, started at the first value (at most 96 values a group)."""
    seq = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("block", F.col(value).cast("double").alias("v")))))
    folded = F.aggregate(F.slice("s", 2, 96), F.element_at("s", 1)["v"], lambda acc, x: alpha * x["v"] + (1 - alpha) * acc)
    return df.groupBy(*keys).agg(seq.alias("s")).where(F.size("s") > 0).select(*keys, folded.alias("ema"))


def ramp_limited(df: DataFrame, value: str, max_ramp: float = 300.0, settled: int = 0, keys: Sequence[str] = ("state", "date"), out: str = "limited") -> DataFrame:
    """Each block after the settled ones stays within +-max_ramp of the *adjusted* block before it.

    A true recurrence: the day's blocks are folded in order inside one array (at most 96 values) and exploded again.
    """
    seq = F.array_sort(F.collect_list(F.struct("block", F.col(value).cast("double").alias("v"))))
    r = F.lit(float(max_ramp))

    def step(acc, x):
        prev = F.element_at(acc, -1)["v"]
        lim = F.least(F.greatest(x["v"], prev - r), prev + r)
        nxt = F.when((F.size(acc) == 0) | (x["block"] <= settled), x["v"]).otherwise(lim)
        return F.concat(acc, F.array(F.struct(x["block"].alias("block"), nxt.alias("v"))))

    start = F.array().cast("array<struct<block:int,v:double>>")
    days = df.groupBy(*keys).agg(seq.alias("s"))
    folded = days.select(*keys, F.explode(F.aggregate("s", start, step)).alias("x")).select(*keys, "x.block", F.col("x.v").alias(out))
    return df.join(folded, [*keys, "block"])
