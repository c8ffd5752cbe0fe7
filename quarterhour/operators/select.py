"""Filters, selections and validity rules over the block series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import block_start
from quarterhour.functions.stats import count_where
from quarterhour.operators.grid import blocks_of_days


def structural_filter(df: DataFrame, start: str, end: str, weekdays: Sequence[int] | None = None, months: Sequence[int] | None = None,
                      blocks: tuple[int, int] | None = None, weekend_only: bool = False) -> DataFrame:
    """Date range plus optional weekday, month, block-range and weekend restrictions."""
    out = df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if weekdays:
        out = out.where(F.weekday("date").isin(*weekdays))
    if months:
        out = out.where(F.month("date").isin(*months))
    if blocks:
        out = out.where(F.col("block").between(*blocks))
    return out.where(F.weekday("date") >= 5) if weekend_only else out


def region_or_all(df: DataFrame, region: str) -> DataFrame:
    """Rows of a region, or every row when the region is unknown. The test stops at the first match."""
    name = F.lower(F.trim(F.col("state"))) == region.lower().strip()
    found = df.where(name).select(F.lit(1).alias("_hit")).limit(1).agg(F.count("_hit").alias("_hits"))
    return df.crossJoin(F.broadcast(found)).where((F.col("_hits") == 0) | name).drop("_hits")


def resample(df: DataFrame, granularity: str, values: Sequence[str]) -> DataFrame:
    """Mean per 15 minutes, hour or day."""
    unit = {"hourly": "hour", "daily": "day"}.get(granularity)
    ts = block_start("date", "block")
    ts = F.date_trunc(unit, ts).cast("timestamp_ntz") if unit else ts
    return df.groupBy("state", ts.alias("ts")).agg(*[F.avg(v).alias(v) for v in values])


def latest_robust_date(df: DataFrame, min_blocks: int = 96, min_mean: float = 100.0) -> DataFrame:
    """Per state the latest date with enough blocks and level, else simply the latest."""
    day = df.groupBy("state", "date").agg(F.count_distinct("block").alias("n"), F.avg("load").alias("m"))
    good = (F.col("n") >= min_blocks) & (F.col("m") > min_mean)
    return day.groupBy("state").agg(F.max(F.when(good, F.col("date"))).alias("robust_date"), F.max("date").alias("last_date"),
                                    count_where(good).alias("robust_days")).withColumn("resolved", F.coalesce("robust_date", "last_date"))


def resolve_date(df: DataFrame, requested: str) -> DataFrame:
    """The requested date where the state has it, else its latest date; ``exact`` tells which."""
    d = F.lit(requested).cast("date")
    return df.groupBy("state").agg(F.max(F.when(F.col("date") == d, d)).alias("_hit"), F.max("date").alias("_last")).select(
        "state", F.coalesce("_hit", "_last").alias("date"), F.col("_hit").isNotNull().alias("exact"))


def valid_prefix(df: DataFrame, floor: float = 50.0) -> DataFrame:
    """Consecutive valid blocks from block 1 on, per day (a missing or low block ends the prefix)."""
    g = blocks_of_days(df.select("state", "date").distinct()).join(df.select("state", "date", "block", "load"), ["state", "date", "block"], "left")
    bad = F.coalesce(F.col("load"), F.lit(0.0)) < floor
    return g.groupBy("state", "date").agg((F.coalesce(F.min(F.when(bad, F.col("block"))), F.lit(97)) - 1).alias("valid_blocks"))


def selection_mask(scope: str, start: int = 1, end: int = 96, block: int = 1) -> Column:
    """1.0 on the selected blocks."""
    b = F.col("block")
    if scope == "range":
        lo, hi = max(1, min(start, end)), min(96, max(start, end))
        return F.when(b.between(lo, hi), 1.0).otherwise(0.0)
    if scope in ("single", "block"):
        return F.when(b == min(max(block, 1), 96), 1.0).otherwise(0.0)
    return F.lit(1.0)


def soft_edges(df: DataFrame, mask: str = "mask", out: str = "soft_mask") -> DataFrame:
    """Half weight on both sides of every edge of a 0/1 mask."""
    w = Window.partitionBy("state", "date").orderBy("block")
    left, right = F.coalesce(F.lag(mask).over(w), F.col(mask)), F.coalesce(F.lead(mask).over(w), F.col(mask))
    m = F.col(mask)
    edge = ((m == 0) & ((left == 1) | (right == 1))) | ((m == 1) & ((left == 0) | (right == 0)))
    return df.withColumn(out, F.when(edge, 0.5).otherwise(m))


def complete_days(df: DataFrame, min_blocks: int = 96, floor: float = 50.0, synthetic: str | None = None) -> DataFrame:
    """(state, date) of days with enough valid blocks and no synthetic row."""
    syn = F.max(F.coalesce(F.col(synthetic), F.lit(0))) if synthetic else F.lit(0)
    day = df.groupBy("state", "date").agg(count_where(F.col("load") > floor).alias("valid_blocks"), syn.alias("_syn"))
    return day.where((F.col("valid_blocks") >= min_blocks) & (F.col("_syn") < 1)).drop("_syn")


def equal_width_bins(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ("state",)) -> DataFrame:
    """Bin number 1..bins between the key's minimum and maximum (the maximum belongs to the last bin)."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(lim, list(keys))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))) + 1
    return j.withColumn("bin", F.when(F.col(value).isNotNull(), F.least(F.coalesce(b, F.lit(1)), F.lit(bins)))).drop("_lo", "_hi")


def tertiles(df: DataFrame, value: str, out: str = "tertile", keys: Sequence[str] = ("state",)) -> DataFrame:
    """Three groups of equal size by rank, earlier rows first among equals.

    Cut points come from exact quantiles of the position, found with one ranking inside each key's bounded calendar.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(value), "date", "block")
    return df.where(F.col(value).isNotNull()).withColumn(out, F.ntile(3).over(w))


def climate_class(t: Column | str, h: Column | str) -> tuple[Column, Column]:
    """Right-closed temperature and humidity classes."""
    t, h = F.col(t) if isinstance(t, str) else t, F.col(h) if isinstance(h, str) else h
    tc = F.when(t <= -10, None).when(t <= 15, "Cool").when(t <= 25, "Mild").when(t <= 35, "Hot").when(t <= 100, "Extreme")
    hc = F.when(h <= -1, None).when(h <= 40, "Dry").when(h <= 70, "Normal").when(h <= 100, "Humid")
    return tc, hc


def first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    """First of several column names that the frame has (wind and holiday columns differ between feeds)."""
    return next((n for n in names if n in df.columns), None)
