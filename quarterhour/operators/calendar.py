"""Calendar fields, holiday context and day types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import cyclic, hour_of, season, weekday


def holiday_flag(df: DataFrame, holidays: DataFrame, out: str = "is_holiday", shift: int = 0) -> DataFrame:
    """1 when the date moved by ``shift`` days is a holiday. The holiday table has a few rows per year."""
    h = F.broadcast(holidays.select(F.date_sub("holiday", shift).alias("date"), F.lit(1).alias(out)).distinct())
    return df.join(h, "date", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def with_calendar(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """dow (Monday 0), weekend and holiday flags, hour and month."""
    d = holiday_flag(df, holidays)
    dow = weekday("date")
    return d.select(*df.columns, dow.alias("dow"), (dow >= 5).cast("int").alias("is_weekend"), "is_holiday",
                    hour_of("block").alias("hour"), F.month("date").alias("month"))


def calendar_fields(df: DataFrame) -> DataFrame:
    """Names, ISO week, quarter, day of year, season and cyclic encodings."""
    dow, m = weekday("date"), F.month("date")
    ds, dc = cyclic(dow, 7.0)
    ms, mc = cyclic(m - 1, 12.0)
    return df.select(
        *df.columns, F.date_format("date", "EEEE").alias("day_name"), F.date_format("date", "MMMM").alias("month_name"),
        F.weekofyear("date").alias("iso_week"), F.quarter("date").alias("quarter"), F.dayofyear("date").alias("day_of_year"),
        season(m).alias("season"), ds.alias("dow_sin"), dc.alias("dow_cos"), ms.alias("month_sin"), mc.alias("month_cos"))


def holiday_distance(days: DataFrame, holidays: DataFrame, cap: int | None = None, no_holiday: int = 999) -> DataFrame:
    """Days to the next and since the last holiday, from one ordered pass over the calendar.

    Without ``cap`` the distance is the true one, and ``no_holiday`` stands where that side has no holiday at all. With
    it, distances end at the cap, which also stands where there is none. The pass sees a row per date, not per reading.
    """
    h = holidays.select(F.col("holiday").alias("date")).distinct().withColumn("_h", F.col("date"))
    dates = days.select("date").where("date is not null").distinct().join(h, "date", "full_outer")
    order = Window.orderBy("date")
    before = F.last("_h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_h", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    limit = (lambda c: F.coalesce(c, F.lit(no_holiday))) if cap is None else (lambda c: F.least(F.coalesce(c, F.lit(cap)), F.lit(cap)))
    near = dates.select("date", limit(F.datediff(after, "date")).alias("days_to_holiday"), limit(F.datediff("date", before)).alias("days_since_holiday"))
    return days.join(near, "date", "left")


def holiday_context(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Flags of a day relative to weekends and holidays: adjacent, bridge, long weekend, mid-week holiday."""
    d = holiday_flag(days, holidays)
    d = holiday_flag(holiday_flag(d, holidays, "hol_prev", -1), holidays, "hol_next", 1)
    dow = weekday("date")
    wk, hol = dow >= 5, F.col("is_holiday") == 1
    return d.select(
        *days.columns, "is_holiday", wk.cast("int").alias("is_weekend"), dow.alias("dow"),
        (hol & (dow == 4)).cast("int").alias("holiday_before_weekend"), (hol & (dow == 0)).cast("int").alias("holiday_after_weekend"),
        (hol & dow.between(1, 3)).cast("int").alias("midweek_holiday"),
        (~wk & ~hol & (((dow == 0) & (F.col("hol_next") == 1)) | ((dow == 4) & (F.col("hol_prev") == 1)))).cast("int").alias("is_bridge"),
        ((hol & dow.isin(0, 4)) | (wk & ((F.col("hol_prev") == 1) | (F.col("hol_next") == 1)))).cast("int").alias("is_long_weekend"),
        "hol_prev", "hol_next")


def daypart(block: Column | str, parts: list[tuple[str, int, int]]) -> Column:
    """Name of the segment that holds a block; a segment whose start exceeds its end wraps midnight."""
    b = F.col(block) if isinstance(block, str) else block
    out = None
    for name, lo, hi in parts:
        hit = b.between(lo, hi) if lo <= hi else ((b >= lo) | (b <= hi))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def date_rank(date: str = "date", keys: tuple[str, ...] = ("state",)) -> Column:
    """1 for the latest date of the key."""
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(date).desc()))


def season_maps(month: Column) -> tuple[Column, Column, Column]:
    """The three season maps in use: four seasons, what-if seasons, backtest seasons."""
    four = F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("fall")
    what_if = F.when(month.isin(6, 7, 8, 9), "monsoon").when(month.isin(11, 12, 1, 2), "winter").otherwise("summer")
    backtest = F.when(month.isin(3, 4, 5), "Summer").when(month.isin(6, 7, 8, 9), "Monsoon").when(month.isin(10, 11), "Post-Monsoon").otherwise("Winter")
    return four, what_if, backtest


def transition_flags(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday transition flags of each date, with true distances (999 where that side has no holiday)."""
    d = holiday_flag(days, holidays)
    d = holiday_flag(holiday_flag(d, holidays, "_p", -1), holidays, "_n", 1)
    dow, hol = weekday("date"), F.col("is_holiday") == 1
    adj = (F.col("_p") == 1) | (F.col("_n") == 1)
    d = d.withColumns({
        "holiday_on_weekday": (hol & (dow < 5)).cast("int"), "holiday_before_weekend": (hol & (dow == 4)).cast("int"),
        "holiday_after_weekend": (hol & (dow == 0)).cast("int"), "bridge_day": (~hol & (dow < 5) & adj).cast("int"),
        "long_weekend": ((dow >= 5) & adj).cast("int"), "midweek_holiday": (hol & dow.between(1, 3)).cast("int")}).drop("_p", "_n")
    return holiday_distance(d, holidays)


def day_type(df: DataFrame) -> Column:
    """Ten-way day type from the transition flags."""
    one = lambda c: F.col(c) == 1
    dow = weekday("date")
    hol = F.when(one("holiday_before_weekend"), "Holiday-Fri").when(one("holiday_after_weekend"), "Holiday-Mon").when(one("midweek_holiday"), "Holiday-MidWeek").otherwise("Holiday")
    return (F.when(one("is_holiday"), hol).when(one("bridge_day"), "BridgeDay").when(one("long_weekend"), "LongWeekend")
            .when(dow >= 5, "Weekend").when(dow == 4, "Friday").when(dow == 0, "Monday").otherwise("Weekday"))


def peak_window(df: DataFrame, q: float = 0.75, min_width: int = 8, fallback: tuple[int, int] = (33, 72), feature: str = "load") -> DataFrame:
    """Longest run of blocks whose median lies at or above the q-quantile of the median profile, else the fallback."""
    from quarterhour.functions.stats import quantile
    from quarterhour.operators.grid import forward_fill, run_ids
    prof = df.groupBy("state", "block").agg(F.median(feature).alias("m"))
    grid = df.select("state").distinct().withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(96))))
    prof = forward_fill(grid.join(prof, ["state", "block"], "left"), "m", ["state"], "block")
    cut = prof.groupBy("state").agg(quantile("m", q).alias("_q"))
    p = run_ids(prof.join(cut, "state").withColumn("peak", F.col("m") >= F.col("_q")), F.col("peak"), ["state"], "block")
    runs = p.where("peak").groupBy("state", "run_id").agg(F.min("block").alias("s"), F.max("block").alias("e"))
    best = runs.withColumn("n", F.col("e") - F.col("s") + 1).groupBy("state").agg(F.max_by(F.struct("s", "e", "n"), F.struct("n", -F.col("s"))).alias("b")).select("state", "b.*")
    ok = F.col("n") >= min_width
    return best.select("state", F.when(ok, F.col("s")).otherwise(fallback[0]).alias("peak_start"), F.when(ok, F.col("e")).otherwise(fallback[1]).alias("peak_end"))
