"""Forecast products: baselines composed with bands, gates, records and boosted residual models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import block_label
from quarterhour.functions.stats import bottom_by, quantile, rank_corr, top_by
from quarterhour.operators import quantile_trees
from quarterhour.operators.baselines import LOOKBACK, ordered_quantiles, recent_day, relative_band
from quarterhour.operators.corrections import seam, seam_anchor
from quarterhour.operators.features import MODEL_FEATURES, join_stats, training_frame
from quarterhour.operators.grid import blocks_of_days, day_calendar, day_lag
from quarterhour.plans.design import design_matrix
from quarterhour.plans.refit import supervised
from quarterhour.sources.sinks import record_id
from quarterhour.sources.stage import shared

DAY = ["state", "date"]


def reference(grid: DataFrame, holidays: DataFrame, horizon: int = 1) -> DataFrame:
    """Recent-day baseline with D-7 and D-h fallbacks on a dense grid."""
    r = recent_day(grid, holidays, horizon).withColumnRenamed("forecast", "_rd")
    d = grid.withColumns({"_l7": day_lag("load", 7), "_lh": day_lag("load", horizon)}).join(r, [*DAY, "block"], "left")
    return d.withColumn("point", F.coalesce("_rd", "_l7", "_lh")).drop("_rd", "_l7", "_lh")


def summary(blocks: DataFrame) -> DataFrame:
    """Energy, peak, minimum, band width and largest ramp of each forecast day."""
    day = Window.partitionBy(*DAY).orderBy("block")
    b = blocks.withColumn("_r", F.abs(F.col("p50") - F.lag("p50").over(day)))
    return b.groupBy(*DAY).agg(
        (F.sum("p50") * 0.25).alias("energy_mwh"), F.max("p50").alias("peak_mw"), top_by("block", "p50", "block").alias("peak_block"), F.min("p50").alias("min_mw"), bottom_by("block", "p50", "block").alias("min_block"),
        F.avg(F.col("p90") - F.col("p10")).alias("mean_band_mw"), F.max("_r").alias("max_ramp_mw"), top_by("block", "_r", "block").alias("max_ramp_block"), (F.count("p50") == 96).alias("complete"))


def drivers(weather: DataFrame) -> DataFrame:
    """Weather drivers of each day from the state weather features."""
    return weather.groupBy(*DAY).agg(
        F.max("temp_wmean").alias("temp_weighted_max"), F.max("temp_p90").alias("temp_p90_max"), F.max("wb_wmean").alias("wet_bulb_weighted_max"), F.max("wb_p90").alias("wet_bulb_p90_max"),
        F.max(F.when(F.col("block") == 96, F.col("cdh24_wmean"))).alias("cdh_24h_end"), F.max("night_min_temp").alias("night_min_temp"), F.max("hot_share").alias("hot_share_peak"), F.sum("precip_wmean").alias("precip_total"))


def day_ahead(grid: DataFrame, holidays: DataFrame, horizon: int = 1, model: str = "recent_day", min_rows: int = 7 * 96) -> DataFrame:
    """Forecast rows of every target date with band, baseline, actual and an immutable record id per (state, date)."""
    b = relative_band(reference(grid, holidays, horizon), "point", horizon, min_rows=min_rows)
    total = F.round(F.coalesce(F.sum("p50"), F.lit(0.0)) + 1e-6).cast("bigint")  # halves do not hang on the order of a sum
    ids = b.groupBy(*DAY).agg(total.alias("_t")).select(*DAY, record_id("state", "date", F.lit(str(horizon)), F.lit(model), "_t").alias("record_id"))
    return b.join(ids, DAY).select(*DAY, "block", block_label("block").alias("time"), "p10", "p50", "p90", F.col("point").alias("baseline"), F.col("load").alias("actual"), "record_id")


def export_table(t1: DataFrame, t2: DataFrame, grid: DataFrame, weather: DataFrame, mw_per_degree: float = 8.0) -> DataFrame:
    """Both horizons in the export layout, with day-over-day load change and the temperature effect."""
    both = t1.withColumn("horizon", F.lit("T+1")).unionByName(t2.withColumn("horizon", F.lit("T+2")), allowMissingColumns=True)
    dod = grid.select(*DAY, "block", (day_lag("load", 1) - day_lag("load", 2)).alias("dod_load_delta_mw"))
    wx = weather.select(*DAY, "block", ((F.col("temperature") - F.col("n_temp")) * mw_per_degree).alias("temp_delta_mw"))
    j = both.join(dod, [*DAY, "block"], "left").join(wx, [*DAY, "block"], "left")
    return j.select("horizon", "date", F.col("state").alias("region"), "block", block_label("block").alias("time"), F.col("point").alias("baseline_mw"), F.col("p50").alias("forecast_mw"), F.col("load").alias("actual_mw"),
                    F.col("p10").alias("p10_mw"), F.col("p90").alias("p90_mw"), "dod_load_delta_mw", "temp_delta_mw")


def two_step(t1: DataFrame, t2: DataFrame, load: DataFrame, window: int = 8) -> DataFrame:
    """T+2 bridged to the level at the end of T+1, which leans on the lag-7 actual."""
    return seam(t2, seam_anchor(t1, load), window).withColumn("t1_date", F.date_sub("date", 1))


def issue(forecasts: DataFrame, horizons: Sequence[int] = (1, 2), point: str = "load") -> DataFrame:
    """One forecast per operating day and horizon (persistence of the operating day)."""
    return forecasts.select("state", F.col("date").alias("issued_on"), "block", F.col(point).alias("forecast"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).withColumn(
        "date", F.date_add("issued_on", F.col("horizon")))


def range_forecast(load: DataFrame, holidays: DataFrame, start: str, end: str, horizon: int = 1) -> DataFrame:
    """Forecast of every date of a range at once; history before the range is cut to what the baselines can reach."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    past = max(7, horizon + LOOKBACK - 1)
    near = load.where(F.col("date").between(F.date_sub(s, past), e))
    g = blocks_of_days(day_calendar(load)).where(F.col("date").between(F.date_sub(s, past), e)).join(near, [*DAY, "block"], "left")
    return reference(g, holidays, horizon).where(F.col("date").between(s, e)).withColumnRenamed("point", "forecast")


MODEL_COLUMNS = ("lag_h_load", "lag_7d_load", "roll7_mean_load", "roll7_std_load", "origin_daily_mean_load", "recent_day_baseline", "block_idx", "block_sin", "block_cos", "dow_sin", "dow_cos",
                 "is_weekend", "is_holiday", "temperature", "humidity")


def boosted_quantiles(grid: DataFrame, frame: DataFrame, holidays: DataFrame, horizon: int = 1, validation_days: int = 14, seed: int = 7) -> DataFrame:
    """Boosted trees on the residual of the reference baseline give the centre, residuals per block give the band.

    The calendar is split in three per state, each part later than the one before: days to fit the trees, ``validation_days``
    to calibrate p10 and p90, and the targets: the last ``validation_days`` with loads and all later, open ones. So a band
    comes from days that neither the trees nor the targets have seen. A missing feature takes the mean of the fitting
    days, and a flag says so. Returns the rows of the targets.
    """
    names = [c for c in MODEL_COLUMNS if c != "block"]
    wx = frame.select(*DAY, "block", "temperature", "humidity")
    d = design_matrix(grid, wx, holidays, horizon)
    d = d.withColumn("_ref", F.coalesce("recent_day_baseline", "lag_7d_load", "lag_h_load")).where("_ref is not null")
    d = d.select(*DAY, "block", "load", "_ref", *[F.col(c).cast("double").alias(c) for c in names])
    last = d.where("load is not null").groupBy("state").agg(F.max("date").alias("_last"))
    part = F.when(F.col("date") > F.date_sub("_last", validation_days), "target").when(F.col("date") > F.date_sub("_last", 2 * validation_days), "calibrate").otherwise("fit")
    d = shared(d.join(last, "state").withColumn("_part", part))
    means = d.where("_part = 'fit'").agg(*[F.avg(c).alias(c) for c in names]).first()
    filled = {c: F.coalesce(F.col(c), F.lit(0.0 if means[c] is None else means[c])) for c in names}
    d = d.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in names]).withColumns(filled)
    vec = VectorAssembler(inputCols=[*names, *[f"{c}_missing" for c in names]], outputCol="features")
    train = vec.transform(d.where("load is not null and _part = 'fit'").withColumn("label", F.col("load") - F.col("_ref")))
    model = GBTRegressor(maxIter=15, maxDepth=4, seed=seed).fit(train.select("features", "label"))
    out = model.transform(vec.transform(d.where("_part <> 'fit'"))).withColumn("_c", F.col("_ref") + F.col("prediction"))
    error = F.col("load") - F.col("_c")
    q = out.where("load is not null and _part = 'calibrate'").groupBy("state", "block").agg(quantile(error, 0.1).alias("_lo"), quantile(error, 0.9).alias("_hi"))
    out = out.where("_part = 'target'").join(q, ["state", "block"], "left")
    p10, p50, p90 = ordered_quantiles(F.col("_c") + F.coalesce("_lo", F.lit(0.0)), F.col("_c"), F.col("_c") + F.coalesce("_hi", F.lit(0.0)))
    return out.select(*DAY, "block", p10.alias("p10"), p50.alias("p50"), p90.alias("p90"))


QUANTILE_FEATURES = ("dev_h", "dev_7d", "dev_roll7", "temp_change", "temperature", "block", "weekday", "is_weekend", "is_holiday")


def quantile_rows(grid: DataFrame, weather: DataFrame, holidays: DataFrame, horizon: int = 1) -> DataFrame:
    """Residuals of the reference baseline with origin-safe features, the input of the quantile trees."""
    return supervised(grid, weather, holidays, (horizon,)).where("reference is not null").withColumn("weekday", F.weekday("date"))


def quantile_forecast(rows: DataFrame, start: str, validation_days: int = 7, **options) -> tuple[DataFrame, quantile_trees.Boosted]:
    """p10, p50 and p90 of all dates from ``start`` on, each by trees of its own; no later day takes part in the fit.

    ``rows`` is what ``quantile_rows`` gives. The last ``validation_days`` before the first target's origin choose the number of
    trees. Features that are missing have a bin of their own. Returns the forecasts and the model.
    """
    d = shared(rows)
    origin = F.date_sub(F.lit(start).cast("date"), F.col("horizon"))
    seen = d.where(F.col("date") <= origin)
    model = quantile_trees.fit(seen, QUANTILE_FEATURES, "residual", validation=F.col("date") > F.date_sub(origin, validation_days), **options)
    keys = [*DAY, "block", "horizon", "load", "reference"]
    out = quantile_trees.predict(d.where(F.col("date") >= F.lit(start).cast("date")), model, keys)
    q = [F.col("reference") + F.get("quantiles", F.lit(i)) for i in range(3)]
    p10, p50, p90 = ordered_quantiles(*q)
    known = F.col("quantiles").isNotNull()
    return out.select(*keys, F.when(known, p10).alias("p10"), F.when(known, p50).alias("p50"), F.when(known, p90).alias("p90")), model


def feature_effects(frame: DataFrame, holidays: DataFrame, top: int = 12, seed: int = 7) -> DataFrame:
    """Share of importance of the leading features of a boosted model, signed by their rank correlation with load."""
    names = [c for c in MODEL_FEATURES if c not in ("lag_block_1", "lag_block_4", "rolling_4", "rolling_12")]
    d = shared(training_frame(frame).where("load is not null").select("state", "block", F.col("load").alias("label"), *[F.col(c).cast("double").alias(c) for c in names if c != "block"]))
    # A missing feature takes the mean of its region and block, else of its region, and a flag says so; the flag's share is the feature's.
    own = join_stats(join_stats(d, ["state", "block"], **{f"_b_{c}": F.avg(c) for c in names}), ["state"], **{f"_s_{c}": F.avg(c) for c in names})
    filled = own.select("label", *[F.coalesce(F.col(c), f"_b_{c}", f"_s_{c}", F.lit(0.0)).cast("double").alias(c) for c in names], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in names])
    vec = VectorAssembler(inputCols=[*names, *[f"{c}_missing" for c in names]], outputCol="features")
    model = GBTRegressor(maxIter=10, maxDepth=4, seed=seed).fit(vec.transform(filled).select("features", "label"))
    imp = model.featureImportances.toArray()
    imp = imp[:len(names)] + imp[len(names):]
    total = float(imp.sum()) or 1.0
    best = sorted(range(len(names)), key=lambda i: -imp[i])[:top]
    # ranked within each state, then combined by the states' rows, so that no task ranks all of them
    by_state = rank_corr(d, ["state"], {names[i]: (names[i], "label") for i in best})
    rho = by_state.groupBy("pair").agg((F.sum(F.col("rho") * F.col("n")) / F.sum("n")).alias("rho"))
    share = F.create_map(*[F.lit(x) for i in best for x in (names[i], float(imp[i] / total))])
    s = F.element_at(share, F.col("pair"))
    return rho.select(F.col("pair").alias("feature"), s.alias("importance_share"), (s * F.signum("rho")).alias("signed_effect"))
