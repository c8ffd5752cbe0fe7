"""Batch what-if tables: scenarios joined with coefficients and block profiles, for all regions at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.stats import avg_where, rank_corr, slope
from quarterhour.operators.features import join_stats
from quarterhour.operators.regress import ols


def scenario_summary(df: DataFrame, keys: list[str], value: str = "final_mw", baseline: str = "baseline_mw") -> DataFrame:
    """Peak, energy and net change of each scenario."""
    b, f = F.sum(baseline), F.sum(value)
    return df.groupBy(*keys).agg(F.max(value).alias("peak_mw"), (f * 0.25).alias("energy_mwh"), (F.try_divide(f - b, b) * 100).alias("net_pct"))


def compare_scenarios(df: DataFrame, base: str, target: str) -> DataFrame:
    """Base and target paired by block in one pass; a block the target lacks keeps the base value."""
    def pick(sid: str):
        return F.max(F.when(F.col("scenario_id") == sid, F.col("final_mw")))
    p = df.where(F.col("scenario_id").isin(base, target)).groupBy("state", "block").agg(pick(base).alias("b"), pick(target).alias("t")).where("b is not null")
    p = p.withColumn("t", F.coalesce("t", "b"))
    return p.groupBy("state").agg((F.max("t") - F.max("b")).alias("peak_change"), ((F.sum("t") - F.sum("b")) * 0.25).alias("energy_change"),
                                  F.max(F.abs(F.col("t") - F.col("b"))).alias("max_block_delta"), F.count(F.lit(1)).alias("blocks"))


# MW-percent coefficients of weather deltas by season; temperature elasticity (% per C), comfort bands and
# sector sensitivities of the step calculation; prior and clip of the adaptive temperature base.
WEATHER_COEFFS = """('summer', 1.8, 0.7, -1.2, -0.3), ('winter', 0.6, 0.7, -1.2, -0.3), ('monsoon', 1.2, 0.9, -1.6, -0.35)"""
TEMP_ELASTICITY = """('summer', 1.8, 24.0, 30.0), ('winter', 0.6, 18.0, 24.0), ('monsoon', 1.2, 22.0, 28.0)"""
SECTOR_SENSITIVITY = {"residential": 1.2, "commercial": 1.0, "industrial": 0.55, "agriculture": 0.75}
TEMP_BASE_CLIP = 0.25


def block_shape(block: Column | str = "block") -> Column:
    """Sensitivity of a block by time of day: morning and evening peaks, night dip, between 0.6 and 1.6."""
    b = F.col(block) if isinstance(block, str) else block
    t = (b - 1) / 95.0
    bump = lambda c, s: F.exp(-F.pow(t - c, F.lit(2.0)) / s)
    raw = 0.78 + 0.52 * bump(0.42, 0.012) + 0.74 * bump(0.78, 0.010) - 0.16 * bump(0.08, 0.030)
    return F.least(F.greatest(raw, F.lit(0.6)), F.lit(1.6))


def weather_impact_table(deltas: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Percent impact of weather deltas per block. ``deltas``: season, block, d_temp, d_hum, d_rain, d_wind; ``coeffs``: season and four numbers."""
    j = deltas.join(F.broadcast(coeffs), "season")
    raw = F.col("d_temp") * F.col("c_temp") + F.col("d_hum") / 10.0 * F.col("c_hum") + F.col("d_rain") / 10.0 * F.col("c_rain") + F.col("d_wind") * F.col("c_wind")
    j = j.withColumn("time_multiplier", block_shape()).withColumn("raw_pct", raw)
    return j.withColumn("weather_pct", F.least(F.greatest(F.col("raw_pct") * F.col("time_multiplier"), F.lit(-15.0)), F.lit(15.0)))


def temperature_steps(rows: DataFrame, elasticity: DataFrame, sector_mix: dict[str, float] | None = None) -> DataFrame:
    """Step table of a temperature change: season, time of day, comfort band, sector mix, clip at +-25 %.

    ``rows``: season, block, base_temp, adjusted_temp; ``elasticity``: season, elasticity, band_lo, band_hi.
    """
    mix = {k: v for k, v in (sector_mix or {}).items() if v > 0}
    sector = sum(v * SECTOR_SENSITIVITY.get(k, 1.0) for k, v in mix.items()) / sum(mix.values()) if mix else 1.0
    j = rows.join(F.broadcast(elasticity), "season")
    t, lo, hi = F.col("adjusted_temp"), F.col("band_lo"), F.col("band_hi")
    gap = F.when(t < lo, lo - t).otherwise(t - hi)
    comfort = F.when(t.between(lo, hi), 0.85).otherwise(F.least(F.lit(1.5), 1.0 + 0.05 * gap))
    j = j.withColumn("temp_delta", t - F.col("base_temp")).withColumn("after_season", F.col("temp_delta") * F.col("elasticity"))
    j = j.withColumn("after_time", F.col("after_season") * block_shape()).withColumn("after_comfort", F.col("after_time") * comfort).withColumn("raw_impact", F.col("after_comfort") * sector)
    return j.withColumn("impact_pct", F.least(F.greatest("raw_impact", F.lit(-25.0)), F.lit(25.0)))


def adaptive_temperature_base(df: DataFrame, coeffs: DataFrame, elasticity: DataFrame, season: str, prior: float = 0.01) -> DataFrame:
    """Relative temperature base per block from the learned asymmetric coefficients, damped off season, scaled by comfort.

    ``coeffs``: state, block, direction (up / down), coefficient.
    """
    c = coeffs.groupBy("state", "block").agg(F.max(F.when(F.col("direction") == "up", F.col("coefficient"))).alias("_u"), F.max(F.when(F.col("direction") == "down", F.col("coefficient"))).alias("_d"))
    e = F.broadcast(elasticity.where(F.col("season") == season).select("band_lo", "band_hi"))
    j = df.join(c, ["state", "block"], "left").crossJoin(e)
    t, lo, hi, dt = F.col("temperature"), F.col("band_lo"), F.col("band_hi"), F.col("temperature") - F.col("n_temp")
    k = F.when(dt >= 0, F.coalesce("_u", F.lit(prior))).otherwise(F.coalesce("_d", F.lit(prior)))
    off = (t >= hi + 2.0) if season == "winter" else (t <= lo - 2.0)
    k = F.when(off, k * 0.35).otherwise(k)
    gap = F.when(t < lo, lo - t).when(t > hi, t - hi).otherwise(0.0)
    comfort = F.when(t.between(lo, hi), 0.85).otherwise(F.least(F.lit(1.6), 1.0 + 0.05 * gap))
    return j.withColumn("effective_coeff", k * comfort).withColumn("temperature_base", F.least(F.greatest(dt * F.col("effective_coeff"), F.lit(-TEMP_BASE_CLIP)), F.lit(TEMP_BASE_CLIP))).drop("_u", "_d")


def sensitivities(df: DataFrame) -> DataFrame:
    """One row per state: temperature and humidity betas (gaps at their mean), rain dip, weekday / weekend / holiday / Friday levels."""
    m = join_stats(df, ["state"], _tm=F.avg("temperature"), _hm=F.avg("humidity"))
    m = m.withColumn("_t", F.coalesce("temperature", "_tm")).withColumn("_h", F.coalesce("humidity", "_hm"))
    b = ols(m, "load", ["_t", "_h"], ["state"], 3).select("state", F.coalesce("beta__t", F.lit(0.0)).alias("temp_beta"), F.coalesce("beta__h", F.lit(0.0)).alias("hum_beta"))
    x, we = F.col("load"), F.col("is_weekend") == 1
    a = df.groupBy("state").agg(
        F.avg(x).alias("base_load"), F.coalesce(avg_where(F.col("precipitation") <= 0.5, x) - avg_where(F.col("precipitation") > 0.5, x), F.lit(0.0)).alias("rain_dip"),
        avg_where(~we, x).alias("weekday_avg"), avg_where(we, x).alias("weekend_avg"), avg_where(F.col("is_holiday") == 1, x).alias("holiday_avg"),
        avg_where(F.col("dow") == 4, x).alias("friday_avg"), avg_where(F.col("dow") == 0, x).alias("monday_avg"))
    return a.join(b, "state", "left")


def deviation_what_if(df: DataFrame, scenarios: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Block curve of every scenario: profile + weather and calendar deviation, shifted later by humidity, + manual MW.

    ``scenarios``: scenario_id, temp_delta, hum_delta, is_raining, is_weekend, is_holiday, is_pre_weekend (0/1), a small
    table. ``adjustments``: scenario_id, block, delta_mw. Each block's shifted value comes from the block k before;
    the first k blocks hold the first available value.
    """
    prof = df.groupBy("state", "block").agg(F.avg("load").alias("baseline_mw"))
    s = sensitivities(df).crossJoin(F.broadcast(scenarios))
    z = F.lit(0.0)
    weather = F.col("temp_beta") * F.col("temp_delta") + F.col("hum_beta") * F.col("hum_delta") - F.col("is_raining") * F.col("rain_dip")
    cal = (-F.col("is_weekend") * F.coalesce(F.col("weekday_avg") - F.col("weekend_avg"), z) - F.col("is_holiday") * F.coalesce(F.col("weekday_avg") - F.col("holiday_avg"), z)
           + F.col("is_pre_weekend") * F.coalesce(F.col("friday_avg") - F.col("weekday_avg"), z))
    s = s.withColumn("weather_mw", weather).withColumn("calendar_mw", cal).withColumn("total_mw", F.col("weather_mw") + F.col("calendar_mw"))
    s = s.withColumn("shift", F.when(F.col("hum_delta") > 0, F.floor(F.col("hum_delta") / 10)).otherwise(0).cast("int"))
    src = s.select("state", "scenario_id", "shift", "total_mw").join(prof, "state")
    first = prof.groupBy("state").agg(F.min_by("baseline_mw", "block").alias("_first"))
    moved = src.select("state", "scenario_id", (F.col("block") + F.col("shift")).alias("block"), F.col("baseline_mw").alias("_m"))
    j = src.join(moved, ["state", "scenario_id", "block"], "left").join(first, "state")
    j = j.withColumn("simulated_mw", F.coalesce("_m", F.col("_first")) + F.col("total_mw"))
    if adjustments is not None:
        j = j.join(F.broadcast(adjustments), ["scenario_id", "block"], "left").withColumn("simulated_mw", F.col("simulated_mw") + F.coalesce("delta_mw", z))
    return j.select("state", "scenario_id", "block", "baseline_mw", "simulated_mw", (F.col("simulated_mw") - F.col("baseline_mw")).alias("deviation_mw"))


def deviation_summary(df: DataFrame, scenarios: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Deviation in MW and percent, class, driver shares and ramp amplification of every scenario."""
    z = F.lit(0.0)
    s = sensitivities(df).crossJoin(F.broadcast(scenarios))
    t, h, r = F.col("temp_beta") * F.col("temp_delta"), F.col("hum_beta") * F.col("hum_delta"), F.col("is_raining") * F.col("rain_dip")
    cal = (-F.col("is_weekend") * F.coalesce(F.col("weekday_avg") - F.col("weekend_avg"), z) - F.col("is_holiday") * F.coalesce(F.col("weekday_avg") - F.col("holiday_avg"), z)
           + F.col("is_pre_weekend") * F.coalesce(F.col("friday_avg") - F.col("weekday_avg"), z))
    s = s.withColumn("_w", t + h - r).withColumn("_c", cal)
    if adjustments is not None:
        m = adjustments.groupBy("scenario_id").agg((F.sum("delta_mw") / 96.0).alias("_m"))
        s = s.join(F.broadcast(m), "scenario_id", "left").withColumn("_m", F.coalesce("_m", z))
    else:
        s = s.withColumn("_m", z)
    dev = F.col("_w") + F.col("_c") + F.col("_m")
    pct = dev / F.col("base_load") * 100
    tot = F.abs("_w") + F.abs("_c") + 0.01
    cls = F.when(F.abs(pct) > 10, "Critical").when(F.abs(pct) > 6, "Elevated").when(F.abs(pct) > 3, "Moderate").otherwise("Low")
    return s.select("state", "scenario_id", dev.alias("deviation_mw"), pct.alias("deviation_pct"), cls.alias("stress_class"), (F.abs(t) / tot * 100).alias("temperature_pct"), (F.abs(h) / tot * 100).alias("humidity_pct"),
                    (F.abs(r) / tot * 100).alias("rain_pct"), (F.abs("_c") / tot * 100).alias("calendar_pct"),
                    F.when(F.col("temp_delta") > 0, F.abs(F.col("temp_delta") * 2 + F.col("hum_delta") * 0.5)).otherwise(0.0).alias("ramp_amplification_pct"))


def stress_index(df: DataFrame, bridge: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Composite stress index (weather, calendar, hybrid) of every scenario, capped at 100. ``bridge``: date of bridge days."""
    z = F.lit(0.0)
    sand = df.join(F.broadcast(bridge.select("date")), "date", "left_semi").groupBy("state").agg(F.avg("load").alias("sandwich_avg"))
    s = sensitivities(df).join(sand, "state", "left").crossJoin(F.broadcast(scenarios))
    w = F.col("temp_beta") * F.col("temp_delta") + F.col("hum_beta") * F.col("hum_delta") - F.col("is_raining") * F.col("rain_dip")
    rel = lambda c: F.coalesce((F.col(c) - F.col("weekday_avg")) / F.col("weekday_avg") * 100, z)
    ws = F.abs(w / F.col("base_load") * 100) * 1.5
    cs = F.abs(rel("weekend_avg")) + F.abs(F.coalesce(F.col("weekday_avg") - F.col("holiday_avg"), z) / F.col("base_load") * 100)
    hs = (F.abs(rel("friday_avg")) + F.abs(rel("monday_avg")) + F.abs(rel("sandwich_avg"))) * 2.0
    idx = F.least(F.lit(100.0), ws * 0.4 + cs * 0.3 + hs * 0.3)
    banner = F.when(idx > 70, "critical").when(idx > 40, "evaluated peak risk").otherwise("normal")
    return s.select("state", "scenario_id", ws.alias("weather_score"), cs.alias("calendar_score"), hs.alias("hybrid_score"), idx.alias("stress_index"), banner.alias("banner"))


def stress_heatmap(df: DataFrame) -> DataFrame:
    """Stress index per weekday and weather class with its risk level; ``is_top`` marks the state's highest cell."""
    from quarterhour.operators.select import climate_class
    tc, hc = climate_class("temperature", "humidity")
    d = df.withColumn("scenario", F.concat_ws("-", F.coalesce(tc, F.lit("nan")), F.coalesce(hc, F.lit("nan"))))
    s = sensitivities(df).select("state", "temp_beta", "hum_beta", "base_load")
    m = df.groupBy("state").agg(F.avg("temperature").alias("_tm"), F.avg("humidity").alias("_hm"), F.percentile("load", F.lit(0.95)).alias("_p95"))
    c = d.groupBy("state", "dow", "scenario").agg(F.avg("temperature").alias("avg_temp"), F.avg("humidity").alias("avg_hum"), F.max("load").alias("max_load"), F.count(F.lit(1)).alias("n"))
    c = c.join(s, "state").join(m, "state")
    w = F.coalesce(F.abs(((F.col("avg_temp") - F.col("_tm")) * F.col("temp_beta") + (F.col("avg_hum") - F.col("_hm")) * F.col("hum_beta")) / F.col("base_load") * 100), F.lit(0.0))
    cs = F.when(F.col("dow") >= 5, 15).otherwise(5) + F.when(F.col("dow").isin(0, 4), 10).otherwise(0)
    c = c.withColumn("stress_index", F.least(F.lit(100.0), w * 0.7 + cs * 0.3))
    x = F.col("stress_index")
    c = c.withColumn("risk_level", F.when(x > 8, "Red").when(x > 5, "Orange").when(x > 2, "Amber").otherwise("Green")).withColumn("has_peak", F.col("max_load") > F.col("_p95"))
    top = F.row_number().over(Window.partitionBy("state").orderBy(F.desc(F.round("stress_index", 9)), "dow", "scenario")) == 1
    return c.withColumn("is_top", top).select("state", "dow", "scenario", "avg_temp", "avg_hum", "n", "stress_index", "risk_level", "has_peak", "is_top")


def full_weather_impact(df: DataFrame, columns: Sequence[str] = ("temperature", "humidity", "precipitation")) -> DataFrame:
    """Slope and rank correlation of load on each weather factor; the strongest is marked."""
    s = df.groupBy("state").agg(*[slope("load", c).alias(c) for c in columns])
    s = s.select("state", F.explode(F.array(*[F.struct(F.lit(c).alias("pair"), F.col(c).alias("slope")) for c in columns])).alias("x")).select("state", "x.*")
    r = rank_corr(df, ["state"], {c: ("load", c) for c in columns})
    j = s.join(r.select("state", "pair", "rho"), ["state", "pair"], "left")
    best = F.row_number().over(Window.partitionBy("state").orderBy(F.desc(F.round(F.abs("rho"), 9)), "pair")) == 1
    return j.withColumn("strongest", best).withColumnRenamed("pair", "factor")
