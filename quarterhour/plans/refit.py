"""Backtests of fitted linear models with weekly refits, all anchors in one job.

A target dated D with horizon h has its origin at D - h and uses the fit of the latest weekly anchor up to that origin. A fit
is a ridge regression, which needs nothing but sums: cross products are added up once per (state, block, horizon, week), a
window over weeks turns them into the sums of every anchor's training span, and each anchor is a small solve from its row.
So one pass over the rows serves all refits, whatever their number, and a hot state is 96 keys with one row a week.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.operators.accuracy import metrics
from quarterhour.operators.baselines import ordered_quantiles, recent_days
from quarterhour.operators.calendar import holiday_flag
from quarterhour.operators.grid import day_lag, days_ago
from quarterhour.plans.backtest import baseline_forecasts
from quarterhour.sources.stage import shared

DAY = ["state", "date"]
FIT, REGION = ["state", "block", "horizon"], ["state", "horizon"]
REFIT_DAYS = 7
#: Distance of the 10 % and 90 % points of a normal error from its centre, in standard deviations.
Z10 = 1.2815515655446004


@dataclass(frozen=True)
class RidgeModel:
    """What is regressed on what. ``residual`` is learnt on top of the reference baseline, ``load`` from scratch."""

    name: str
    target: str
    features: tuple[str, ...]
    alpha: float = 1.0


RESIDUAL = RidgeModel("ridge_residual", "residual", ("dev_h", "dev_7d", "temp_change"))
DIRECT = RidgeModel("ridge_direct", "load", ("lag_h_load", "lag_7d_load", "temp_change"))


def supervised(grid: DataFrame, weather: DataFrame, holidays: DataFrame, horizons: Sequence[int] = (1, 2)) -> DataFrame:
    """A row per (state, date, block, horizon): load, the reference baseline, the residual and origin-safe features.

    ``weather``: state, date, block, temperature. All lags of all horizons share the (state, block) ordering of the grid,
    and the days of the recent-day baseline are chosen once for all horizons.
    """
    d = grid.join(weather.select(*DAY, "block", "temperature"), [*DAY, "block"], "left")
    lags = {"_l7": day_lag("load", 7)}
    for h in horizons:
        lags |= {f"_l{h}d": day_lag("load", h), f"_t{h}": day_lag("temperature", h), f"_m{h}": F.avg("load").over(days_ago(("state", "block"), h + 6, h))}
    d = holiday_flag(d.withColumns(lags), holidays, "is_holiday").withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))
    d = d.join(recent_days(grid, holidays, tuple(horizons)), [*DAY, "block"], "left")
    options = F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(f"h{h}", "_l7", f"_l{h}d").alias("reference"), F.col(f"_l{h}d").alias("lag_h_load"), F.col(f"_m{h}").alias("roll7_mean_load"),
                                 (F.col("temperature") - F.col(f"_t{h}")).alias("temp_change")) for h in horizons])
    long = d.select(*DAY, "block", "load", F.col("_l7").alias("lag_7d_load"), "temperature", "is_weekend", "is_holiday", F.explode(options).alias("o")).select("*", "o.*").drop("o")
    return long.withColumns({"residual": F.col("load") - F.col("reference"), "dev_h": F.col("lag_h_load") - F.col("reference"), "dev_7d": F.col("lag_7d_load") - F.col("reference"), "dev_roll7": F.col("roll7_mean_load") - F.col("reference")})


def with_weeks(rows: DataFrame, start: str) -> DataFrame:
    """fit_week: the anchor a target uses. train_week: the first anchor that has seen the row.

    Anchor k of a horizon is k weeks after ``start`` less the horizon; it has seen all dates up to itself.
    """
    ahead = F.datediff("date", F.lit(start).cast("date"))
    return rows.withColumn("fit_week", F.floor(ahead / REFIT_DAYS).cast("int")).withColumn("train_week", F.ceil((ahead + F.col("horizon")) / REFIT_DAYS).cast("int"))


def variables(models: Sequence[RidgeModel]) -> list[str]:
    return list(dict.fromkeys(v for m in models for v in (m.target, *m.features)))


def weekly_sums(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = FIT) -> DataFrame:
    """Per key and week: n, sums s_i and products p_i_j. Rows with a missing variable are no training rows.

    An anchor gets a row of its own, without sums, since its week may have none.
    """
    whole = rows
    for v in names:
        whole = whole.where(F.col(v).isNotNull())
    x = [F.col(v).cast("double") for v in names]
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]]
    weekly = whole.groupBy(*keys, F.col("train_week").alias("week")).agg(*sums).withColumn("is_anchor", F.lit(False))
    anchors = rows.select(*keys, F.col("fit_week").alias("week")).where("week >= 0").distinct().withColumn("is_anchor", F.lit(True))
    return weekly.unionByName(anchors, allowMissingColumns=True)


def pooled(weekly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same sums for fewer keys."""
    sums = [c for c in weekly.columns if c == "n" or c[0] in "sp" and c[1:2].isdigit()]
    return weekly.groupBy(*keys, "week", "is_anchor").agg(*[F.sum(c).alias(c) for c in sums])


def training_sums(weekly: DataFrame, keys: Sequence[str] = FIT, train_weeks: int = 104) -> DataFrame:
    """Per key and anchor: the sums of the ``train_weeks`` weeks up to it."""
    sums = [c for c in weekly.columns if c not in (*keys, "week", "is_anchor")]
    span = Window.partitionBy(*keys).orderBy("week").rangeBetween(1 - train_weeks, 0)
    running = weekly.select(*keys, "week", "is_anchor", *[F.coalesce(F.sum(c).over(span), F.lit(0.0)).alias(c) for c in sums])
    return running.where("is_anchor").drop("is_anchor")


def ridge(n: np.ndarray, sums: np.ndarray, products: np.ndarray, target: int, features: Sequence[int], alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercepts, coefficients and residual deviations of a stack of problems (m; m x v; m x v x v).

    Features are standardised for the penalty, the intercept is free; a feature that never varies gets 0.
    """
    f = list(features)
    mean = sums / n[:, None]
    cov = products / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    c, b, vy = cov[:, f][:, :, f], cov[:, f, target], cov[:, target, target]
    var = np.clip(np.einsum("mii->mi", c), 0, None)
    live = var > 1e-9
    c = np.where(live[:, :, None] & live[:, None, :], c, 0.0)
    penalty = np.where(live, var, 1.0) * (alpha / n)[:, None]
    beta = np.linalg.solve(c + penalty[:, :, None] * np.eye(len(f)), np.where(live, b, 0.0)[:, :, None])[:, :, 0]
    left = vy - 2 * np.einsum("mi,mi->m", beta, np.where(live, b, 0.0)) + np.einsum("mi,mij,mj->m", beta, c, beta)
    return mean[:, target] - np.einsum("mi,mi->m", beta, mean[:, f]), beta, np.sqrt(np.clip(left, 0, None))


def fits(sums: DataFrame, names: Sequence[str], models: Sequence[RidgeModel], keys: Sequence[str] = FIT, min_rows: int = 10) -> DataFrame:
    """Per key, week and model: intercept, beta (array), sigma, n. Keys with fewer than ``min_rows`` rows have no fit."""
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in (*keys, "week")], "model string", "intercept double", "beta array<double>", "sigma double", "n double"])
    v = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["n"] >= min_rows]
            if pdf.empty:
                continue
            n, s, p = pdf["n"].to_numpy(), pdf[[f"s{i}" for i in range(v)]].to_numpy(), np.zeros((len(pdf), v, v))
            for i in range(v):
                for j in range(i, v):
                    p[:, i, j] = p[:, j, i] = pdf[f"p{i}_{j}"].to_numpy()
            for m in models:
                a, beta, sigma = ridge(n, s, p, names.index(m.target), [names.index(f) for f in m.features], m.alpha)
                yield pdf[[*keys, "week"]].assign(model=m.name, intercept=a, beta=list(beta), sigma=sigma, n=n)

    return sums.mapInPandas(solve, schema)


def fitted_forecasts(rows: DataFrame, start: str, end: str, models: Sequence[RidgeModel] = (RESIDUAL, DIRECT), train_weeks: int = 104, min_rows: int = 10, min_region_rows: int = 40) -> DataFrame:
    """state, date, block, horizon, model, actual, forecast, p10, p90, fit for the target dates from start to end.

    ``fit`` is ``block`` where the block has enough training rows, else ``region`` (all blocks of the state). A target without
    either, or one that lacks a feature, gets the reference baseline without a band, and no fit.
    """
    names = variables(models)
    rows = shared(with_weeks(rows.where(F.col("date") <= F.lit(end).cast("date")), start))  # read for the sums, the anchors and the targets
    weekly = shared(weekly_sums(rows, names))
    own = fits(training_sums(weekly, FIT, train_weeks), names, models, FIT, min_rows)
    wide = fits(training_sums(pooled(weekly, REGION), REGION, train_weeks), names, models, REGION, min_region_rows)
    targets = rows.where(F.col("date") >= F.lit(start).cast("date"))
    offers = F.array(*[F.struct(F.lit(m.name).alias("model"), F.array(*[F.col(f).cast("double") for f in m.features]).alias("x"), F.col("reference" if m.target == "residual" else "_zero").alias("base")) for m in models])
    asked = targets.withColumn("_zero", F.lit(0.0)).select(*DAY, "block", "horizon", F.col("fit_week").alias("week"), "load", "reference", F.explode(offers).alias("o")).select("*", "o.*").drop("o")
    found = F.struct("intercept", "beta", "sigma")
    j = asked.join(own.select(*FIT, "week", "model", found.alias("_own")), [*FIT, "week", "model"], "left").join(wide.select(*REGION, "week", "model", found.alias("_wide")), [*REGION, "week", "model"], "left")
    j = j.withColumn("_m", F.coalesce("_own", "_wide"))
    effect = F.aggregate(F.zip_with("_m.beta", "x", lambda b, x: b * x), F.lit(0.0), lambda total, e: total + e)  # NULL if a feature is missing
    j = j.withColumn("_c", F.col("base") + F.col("_m.intercept") + effect)
    p10, p50, p90 = ordered_quantiles(F.col("_c") - Z10 * F.col("_m.sigma"), F.col("_c"), F.col("_c") + Z10 * F.col("_m.sigma"))
    known = F.col("_c").isNotNull()
    level = F.when(known, F.when(F.col("_own").isNotNull(), "block").otherwise("region"))
    return j.select(*DAY, "block", "horizon", "model", F.col("load").alias("actual"), F.when(known, p50).otherwise(F.col("reference")).alias("forecast"), F.when(known, p10).alias("p10"), F.when(known, p90).alias("p90"), level.alias("fit"))


def fitted_backtest(grid: DataFrame, weather: DataFrame, holidays: DataFrame, start: str, end: str, horizons: Sequence[int] = (1, 2), models: Sequence[RidgeModel] = (RESIDUAL, DIRECT), train_weeks: int = 104,
                    min_rows: int = 10, min_history_days: int = 0) -> DataFrame:
    """Metrics per state, model and horizon of the baselines and of the models refitted every week, on the same targets.

    Targets whose region has had fewer than ``min_history_days`` days with readings up to their origin are left out.
    """
    fitted = fitted_forecasts(supervised(grid, weather, holidays, horizons), start, end, models, train_weeks, min_rows)
    plain = baseline_forecasts(grid, holidays, horizons).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    both = fitted.drop("fit").unionByName(plain, allowMissingColumns=True)
    if min_history_days:
        days = grid.groupBy(*DAY).agg(F.count("load").alias("_n"))
        seen = days.withColumn("_days", F.sum((F.col("_n") > 0).cast("int")).over(Window.partitionBy("state").orderBy("date")))
        origin = seen.select("state", F.col("date").alias("origin_date"), "_days")
        both = both.withColumn("origin_date", F.date_sub("date", F.col("horizon"))).join(origin, ["state", "origin_date"]).where(F.col("_days") >= min_history_days)
    return metrics(both, ["state", "model", "horizon"])
