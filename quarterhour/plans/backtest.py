"""Rolling-origin backtests over all target dates, horizons and models at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterhour.operators.accuracy import metrics
from quarterhour.operators.baselines import recent_days
from quarterhour.operators.grid import day_lag

DAY = ["state", "date"]


def baseline_forecasts(grid: DataFrame, holidays: DataFrame, horizons: Sequence[int] = (1, 2)) -> DataFrame:
    """Seasonal-naive and recent-day forecasts for every date and horizon, each with its fallbacks.

    The lags of all horizons share one (state, block) ordering; the recent-day choice is made once
    for all horizons on the daily list.
    """
    d = grid.withColumn("_l7", day_lag("load", 7)).withColumns({f"_h{h}": day_lag("load", h) for h in horizons})
    r = recent_days(grid, holidays, tuple(horizons))
    d = d.join(r.select(*DAY, "block", *[F.col(f"h{h}").alias(f"_r{h}") for h in horizons]), [*DAY, "block"], "left")
    items = []
    for h in horizons:
        naive, recent = F.coalesce("_l7", f"_r{h}", f"_h{h}"), F.coalesce(f"_r{h}", "_l7", f"_h{h}")
        items += [F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), f.alias("forecast")) for m, f in (("seasonal_naive", naive), ("recent_day", recent))]
    return d.select(*DAY, "block", F.col("load").alias("actual"), F.explode(F.array(*items)).alias("x")).select(*DAY, "block", "actual", "x.*")


def with_fit_origin(df: DataFrame, start: str, refit_days: int = 7) -> DataFrame:
    """Origin of each target and the weekly anchor whose fit it would use (anchor + whole weeks up to the origin)."""
    origin = F.date_sub("date", F.col("horizon"))
    anchor = F.date_sub(F.lit(start).cast("date"), F.col("horizon"))
    step = F.floor(F.datediff(origin, anchor) / refit_days) * refit_days
    return df.withColumn("origin_date", origin).withColumn("fit_origin", F.date_add(anchor, step.cast("int")))


def rolling_origin(grid: DataFrame, holidays: DataFrame, start: str, end: str, horizons: Sequence[int] = (1, 2), min_history_days: int = 0) -> DataFrame:
    """Metrics per state, model and horizon over the target dates; targets with too little history are left out."""
    d = baseline_forecasts(grid, holidays, horizons)
    d = with_fit_origin(d.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), start)
    if min_history_days:
        first = grid.where("load is not null").groupBy("state").agg(F.min("date").alias("_first"))
        d = d.join(first, "state").where(F.datediff("origin_date", "_first") + 1 >= min_history_days)
    return metrics(d, ["state", "model", "horizon"])
