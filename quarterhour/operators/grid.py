"""Shared kernel: dense grids, keyed lags, interpolation, slices with a halo, runs.

Scale notes
* Meter rows are always pre-aggregated to (state, date, block) before anything here, so a hot state
  contributes at most 96 rows per day however many raw rows it has.
* Day lags use range frames over the day number in windows partitioned by (state, block): no self-join, no
  dense grid, and one shuffle serves every lag.
* Block-order windows with a bounded frame run on (state, slice): the series is cut into slices of a few weeks,
  and each slice borrows the rows just outside it (the halo), so no task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quarterhour import BLOCKS_PER_DAY
from quarterhour.functions.blocks import block_index, day_number

SLICE_DAYS = 28


def day_calendar(df: DataFrame, keys: Sequence[str] = ("state",), date: str = "date",
                 start: str | None = None, end: str | None = None, extra_days: int = 0) -> DataFrame:
    """One row per key and calendar day between the first and last date of the key (or fixed bounds)."""
    lo = F.lit(start).cast("date") if start else F.min(date)
    hi = F.lit(end).cast("date") if end else F.max(date)
    bounds = df.where(F.col(date).isNotNull()).groupBy(*keys).agg(lo.alias("_lo"), F.date_add(hi, extra_days).alias("_hi"))
    return bounds.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(date))


def blocks_of_days(days: DataFrame, block: str = "block") -> DataFrame:
    return days.withColumn(block, F.explode(F.sequence(F.lit(1), F.lit(BLOCKS_PER_DAY))))


def dense_grid(df: DataFrame, keys: Sequence[str] = ("state",), date: str = "date", block: str = "block", **bounds) -> DataFrame:
    """Every (key, day, block) of the covered range; absent readings are NULL."""
    grid = blocks_of_days(day_calendar(df, keys, date, **bounds), block)
    return grid.join(df, [*keys, date, block], "left")


def days_ago(keys: Sequence[str], first: int, last: int | None = None, date: str = "date") -> WindowSpec:
    """Frame that covers the days ``first`` .. ``last`` before the row (positive = past)."""
    last = first if last is None else last
    return Window.partitionBy(*keys).orderBy(day_number(date)).rangeBetween(-first, -last)


def day_lag(value: str | Column, k: int, keys: Sequence[str] = ("state", "block"), date: str = "date") -> Column:
    """Value of the same key exactly k days earlier; NULL when that day has no row."""
    return F.max(value).over(days_ago(keys, k, date=date))


def sliced(df: DataFrame, back: int, ahead: int = 0, keys: Sequence[str] = ("state",), slice_days: int = SLICE_DAYS,
           date: str = "date", block: str = "block") -> DataFrame:
    """Add ``t`` (absolute block), ``_slice`` and ``_core``; rows within reach of another slice are copied into it.

    Windows partitioned by (keys, _slice), ordered by t, with frames no longer than the halo are exact on core rows.
    ``back`` and ``ahead`` count quarter hours and must not exceed the slice length.
    """
    n = slice_days * BLOCKS_PER_DAY
    assert max(back, ahead) <= n
    t = block_index(date, block)
    own = F.floor(t / n)
    first, last = F.floor((t - ahead) / n), F.floor((t + back) / n)
    out = df.withColumn("t", t).withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(first, last)))
    return out.withColumn("_core", F.col("_slice") == F.col("_own")).drop("_own")


def slice_window(keys: Sequence[str] = ("state",)) -> WindowSpec:
    return Window.partitionBy(*keys, "_slice").orderBy("t")


def core_rows(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_core", "_slice")


def blocks_back(value: str | Column, k: int, keys: Sequence[str] = ("state",)) -> Column:
    """Value exactly k quarter hours earlier (negative = later) on a sliced frame."""
    return F.max(value).over(slice_window(keys).rangeBetween(-k, -k))


def rolling(fn: Column, width: int, keys: Sequence[str] = ("state",)) -> Column:
    """Aggregate over the last ``width`` quarter hours, current one included, on a sliced frame."""
    return fn.over(slice_window(keys).rangeBetween(-(width - 1), 0))


def interpolate(df: DataFrame, value: str, keys: Sequence[str], order: Column | str, out: str | None = None,
                hold_edges: bool = True) -> DataFrame:
    """Linear interpolation over ``order`` inside each key; the ends hold the nearest reading.

    The look-ahead uses a descending window, because a frame that ends at unbounded following is re-evaluated for
    every row. Keys should name a bounded group (a day, or one state's dense calendar).
    """
    out = out or value
    pos = F.col(order) if isinstance(order, str) else order
    point = F.when(F.col(value).isNotNull(), F.struct(pos.cast("double").alias("p"), F.col(value).cast("double").alias("v")))
    fwd = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rev = Window.partitionBy(*keys).orderBy(pos.desc()).rowsBetween(Window.unboundedPreceding, 0)
    df = (df.withColumn("_prev", F.last(point, ignorenulls=True).over(fwd))
          .withColumn("_next", F.last(point, ignorenulls=True).over(rev)))
    gap = F.col("_next.p") - F.col("_prev.p")
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * (pos - F.col("_prev.p")) / gap
    inside = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(gap > 0, line)
    filled = F.coalesce(inside, F.col("_prev.v"), F.col("_next.v")) if hold_edges else inside
    return df.withColumn(out, filled).drop("_prev", "_next")


def forward_fill(df: DataFrame, value: str, keys: Sequence[str], order: Column | str, back_too: bool = True) -> DataFrame:
    """Last seen value; with ``back_too`` the head takes the first one."""
    pos = F.col(order) if isinstance(order, str) else order
    fwd = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rev = Window.partitionBy(*keys).orderBy(pos.desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = [F.last(value, ignorenulls=True).over(fwd)]
    if back_too:
        parts.append(F.last(value, ignorenulls=True).over(rev))
    return df.withColumn(value, F.coalesce(*parts))


def run_ids(df: DataFrame, flag: Column, keys: Sequence[str], order: str, out: str = "run_id") -> DataFrame:
    """Number the maximal runs of rows with equal ``flag`` (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(flag).over(w).eqNullSafe(flag), 0).otherwise(1)
    return (df.withColumn("_chg", change)
            .withColumn(out, F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_chg"))


def run_length_so_far(df: DataFrame, flag: Column, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """Consecutive true rows that end at each row (0 where false)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    df = df.withColumn("_grp", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    w2 = Window.partitionBy(*keys, "_grp").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(w2)).drop("_f", "_grp")
