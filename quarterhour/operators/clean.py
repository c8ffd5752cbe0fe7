"""Repair of demand and weather series. Missing stays NULL unless an operator says it fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import add_minutes, block_index, block_of
from quarterhour.functions.stats import quantile, windowed_median
from quarterhour.operators.grid import blocks_of_days, dense_grid, forward_fill, interpolate, run_ids

DAY = ["state", "date"]


def bounded(df: DataFrame, value: str, lower: float, upper: float, method: str = "const", keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Readings outside [lower, upper] (constants, or quantiles 0..1 of the key) become NULL, then last value carries."""
    if method == "quantile":
        lim = df.groupBy(*keys).agg(quantile(value, lower).alias("_lo"), quantile(value, upper).alias("_hi"))
        df = df.join(lim, list(keys))
    else:
        df = df.withColumn("_lo", F.lit(float(lower))).withColumn("_hi", F.lit(float(upper)))
    kept = df.withColumn(value, F.when(F.col(value).between(F.col("_lo"), F.col("_hi")), F.col(value))).drop("_lo", "_hi")
    return forward_fill(kept, value, list(keys), block_index("date", "block"))


def spike_flags(df: DataFrame, value: str, threshold: float, strict: bool = False) -> Column:
    """True where a reading jumps away from both neighbours of its day (from one, at the ends)."""
    w = Window.partitionBy(*DAY).orderBy("block")
    left, right = F.abs(F.col(value) - F.lag(value).over(w)), F.abs(F.lead(value).over(w) - F.col(value))
    both = (left + right) / 2.0 > threshold
    if strict:
        both = both & (left > threshold) & (right > threshold)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.coalesce(F.when(first & last, False).when(first, right > threshold).when(last, left > threshold).otherwise(both), F.lit(False))


def fix_spikes(df: DataFrame, value: str = "load", threshold: float = 500.0, strict: bool = False) -> DataFrame:
    """Replace continuity spikes by interpolation inside the day."""
    f = df.withColumn("was_spike", spike_flags(df, value, threshold, strict))
    f = f.withColumn(value, F.when(~F.col("was_spike"), F.col(value)))
    w = Window.partitionBy(*DAY).orderBy("block")
    return interpolate(f.withColumn("_pos", F.row_number().over(w)), value, DAY, "_pos").drop("_pos")


def fill_zeros_until(df: DataFrame, end_date: str, end_block: int, value: str = "load") -> DataFrame:
    """Zeros up to a cut date and block are interpolated inside their day; a day of zeros only is left as it is."""
    d = F.lit(end_date).cast("date")
    eligible = (F.col("date") < d) | ((F.col("date") == d) & (F.col("block") <= end_block))
    f = df.withColumn("_v", F.when(~(eligible & (F.col(value) == 0)), F.col(value)))
    w = Window.partitionBy(*DAY).orderBy("block")
    f = interpolate(f.withColumn("_pos", F.row_number().over(w)), "_v", DAY, "_pos")
    return f.withColumn("was_zero", eligible & (F.col(value) == 0)).withColumn(value, F.coalesce("_v", value)).drop("_v", "_pos")


def smooth_drops(df: DataFrame, value: str = "load", window: int = 13, delta: float = 200.0, factor: float = 0.9,
                 max_run: int = 4) -> DataFrame:
    """Short dips below the centred running median are interpolated; longer ones are real and stay."""
    half = window // 2
    w = Window.partitionBy(*DAY).orderBy("block")
    f = df.withColumn("_med", windowed_median(value, w.rowsBetween(-half, half)))
    cand = F.coalesce((F.col("_med") - F.col(value) > delta) & (F.col(value) < factor * F.col("_med")), F.lit(False))
    f = run_ids(f.withColumn("_cand", cand), F.col("_cand"), DAY, "block", "_run")
    n = F.count(F.lit(1)).over(Window.partitionBy(*DAY, "_run"))
    f = f.withColumn("was_drop", F.col("_cand") & (n <= max_run))
    f = f.withColumn(value, F.when(~F.col("was_drop"), F.col(value))).withColumn("_pos", F.row_number().over(w))
    return interpolate(f, value, DAY, "_pos").drop("_med", "_cand", "_run", "_pos")


def fill_grid(df: DataFrame, value: str = "load", keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Dense 96-block grid with gaps interpolated along time and the ends held."""
    g = dense_grid(df.select(*keys, "date", "block", value), keys)
    return interpolate(g, value, list(keys), block_index("date", "block"))


def quarter_rain(hourly: DataFrame, value: str = "precipitation", keys: tuple[str, ...] = ("state", "location")) -> DataFrame:
    """Hourly rain (labelled by the end of the hour) as four equal quarters at t, t-15, t-30 and t-45 minutes.

    Input has keys, ts, value; repeated hours are averaged first.
    """
    h = hourly.where(F.col(value).isNotNull()).groupBy(*keys, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg(value).alias("_v"))
    parts = h.select(*keys, "ts", "_v", F.explode(F.array(*[F.lit(m) for m in (0, 15, 30, 45)])).alias("_back"))
    parts = parts.select(*keys, add_minutes("ts", -F.col("_back")).alias("ts"), "_v")
    out = parts.groupBy(*keys, "ts").agg((F.sum("_v") / 4.0).alias(value))
    return out.select(*keys, F.to_date("ts").alias("date"), block_of("ts").alias("block"), value)


def hourly_to_blocks(hourly: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = ("state", "location")) -> DataFrame:
    """Hourly readings placed on the quarter-hour grid of each place and interpolated along time."""
    g = dense_grid(hourly.select(*keys, "date", "block", *values), keys)
    for v in values:
        g = interpolate(g, v, list(keys), block_index("date", "block"))
    return g


def full_day(df: DataFrame, load: str = "load", weather: tuple[str, ...] = ()) -> DataFrame:
    """Each present day on 96 blocks: duplicates averaged, weather interpolated inside the day, load gaps left NULL."""
    a = df.groupBy(*DAY, "block").agg(F.avg(load).alias(load), *[F.avg(c).alias(c) for c in weather])
    g = blocks_of_days(df.select(*DAY).distinct()).join(a, [*DAY, "block"], "left")
    for c in weather:
        g = interpolate(g, c, DAY, "block")
    return g


def vector_of_day(df: DataFrame, value: str = "load") -> DataFrame:
    """One ARRAY of 96 values per day, gaps interpolated, ends held."""
    g = interpolate(blocks_of_days(df.select(*DAY).distinct()).join(df.select(*DAY, "block", value), [*DAY, "block"], "left"), value, DAY, "block")
    packed = F.array_sort(F.collect_list(F.struct("block", F.col(value).alias("v"))))
    return g.groupBy(*DAY).agg(packed.alias("p")).select(*DAY, F.transform("p", lambda x: x["v"]).alias("vec"))


def patch(df: DataFrame, patches: DataFrame, value: str = "load") -> DataFrame:
    """Copy block ranges from one day to another. ``patches``: state, from_date, to_date, b_lo, b_hi (operator-made, few rows)."""
    src = df.select("state", F.col("date").alias("from_date"), "block", F.col(value).alias("_p"))
    cells = patches.select("*", F.explode(F.sequence("b_lo", "b_hi")).alias("block"))
    new = cells.join(src, ["state", "from_date", "block"]).select("state", F.col("to_date").alias("date"), "block", "_p")
    out = df.join(new, [*DAY, "block"], "left")
    return out.withColumn("patched", F.col("_p").isNotNull()).withColumn(value, F.coalesce("_p", value)).drop("_p")
