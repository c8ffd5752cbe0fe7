"""Spatial weather aggregation, event flags and daily weather context."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour import BLOCKS_PER_DAY
from quarterhour.dims import WEATHER
from quarterhour.functions.blocks import day_number
from quarterhour.functions.numbers import nonneg, ratio
from quarterhour.functions.physics import degrees_above, dew_point, wet_bulb
from quarterhour.functions.stats import avg_where, count_where, pearson, quantile, weighted_avg
from quarterhour.operators.features import join_stats
from quarterhour.operators.grid import core_rows, day_lag, days_ago, rolling, run_length_so_far, sliced

DAY = ["state", "date"]
KEY = ["state", "date", "block"]
ST = ("state",)


def degree_hours(df: DataFrame, k: int, base: float = 24.0, out: str = "cdh", min_fraction: float = 0.75, keys: Sequence[str] = ("state", "location"),
                 degree: Column | None = None) -> DataFrame:
    """Trailing cooling-degree hours over k quarter hours, rescaled to the full window when enough of it is present.

    The first k-1 quarter hours of a state's calendar have no full window and stay NULL.
    """
    start = df.groupBy("state").agg((F.min(day_number("date")).cast("bigint") * BLOCKS_PER_DAY + 1).alias("_t0"))
    d = df.withColumn("_cd", degrees_above("temperature", base) if degree is None else degree).join(start, "state")
    s = sliced(d, back=k, keys=keys)
    total, n = rolling(F.sum("_cd"), k, keys), rolling(F.count("_cd"), k, keys)
    ok = (F.col("t") - F.col("_t0") >= k - 1) & (n >= min_fraction * k)
    return core_rows(s.withColumn(out, F.when(ok, total * (k / n) * 0.25))).drop("_cd", "_t0", "t")


@dataclass(frozen=True)
class HeatLimits:
    hot_temp: float = 35.0
    hot_wet_bulb: float = 26.0
    degree_base: float = 24.0
    hot_day: float = 38.0
    night: tuple[int, int] = (1, 24)


def share_at_or_above(value: Column, weight: Column, limit: float) -> Column:
    """Share of the reporting weight whose value is at or above the limit."""
    return F.try_divide(F.sum(F.when(value >= limit, weight).otherwise(F.when(value.isNotNull(), 0.0))), F.sum(F.when(value.isNotNull(), weight)))


def state_weather(long: DataFrame, weights: DataFrame, limits: HeatLimits = HeatLimits(), min_fraction: float = 0.75) -> DataFrame:
    """District weather -> one row per (state, date, block).

    Physics is computed per district before aggregation. Weighted means are renormalised over the districts that
    report. ``weights`` (location, weight) is a small dimension; districts outside it weigh 0. Rows exist where at
    least one district reports.
    """
    # the total weight rides along with the small weight table
    all_rows = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = weights.select("location", F.col("weight").cast("double").alias("_w"), F.sum(F.col("weight").cast("double")).over(all_rows).alias("_wt"))
    d = long.groupBy("state", "location", "date", "block").agg(*[F.avg(c).alias(c) for c in WEATHER])
    start = d.groupBy("state").agg((F.min(day_number("date")).cast("bigint") * BLOCKS_PER_DAY + 1).alias("_t0"))
    d = d.join(start, "state").withColumn("_cd", degrees_above("temperature", limits.degree_base))
    k = ("state", "location")
    s = sliced(d, back=96, keys=k)

    def hours(n: int) -> Column:
        cnt = rolling(F.count("_cd"), n, k)
        ok = (F.col("t") - F.col("_t0") >= n - 1) & (cnt >= min_fraction * n)
        return F.when(ok, rolling(F.sum("_cd"), n, k) * (n / cnt) * 0.25)

    d = core_rows(s.withColumns({"cdh6": hours(24), "cdh24": hours(96)}))
    d = d.join(w, "location", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    d = d.withColumns({"wb": wet_bulb("temperature", "humidity"), "dew": dew_point("temperature", "humidity")})
    wm = lambda c: weighted_avg(c, "_w")
    t, wb = F.col("temperature"), F.col("wb")
    g = d.groupBy(*KEY).agg(
        F.avg(t).alias("temp_mean"), F.avg("humidity").alias("hum_mean"), wm("temperature").alias("temp_wmean"), wm("humidity").alias("hum_wmean"), wm("wb").alias("wb_wmean"),
        wm("dew").alias("dew_wmean"), wm("precipitation").alias("precip_wmean"), wm("cloud_cover").alias("cloud_wmean"), wm("wind_speed_10m").alias("wind_wmean"),
        wm("direct_radiation").alias("rad_wmean"), quantile(t, 0.9).alias("temp_p90"), F.max(t).alias("temp_max"), F.stddev_pop(t).alias("temp_std"),
        share_at_or_above(t, F.col("_w"), limits.hot_temp).alias("hot_share"), quantile(wb, 0.9).alias("wb_p90"), F.max(wb).alias("wb_max"),
        share_at_or_above(wb, F.col("_w"), limits.hot_wet_bulb).alias("wb_hot_share"), wm("cdh6").alias("cdh6_wmean"), wm("cdh24").alias("cdh24_wmean"),
        quantile("cdh24", 0.9).alias("cdh24_p90"), F.sum(F.when(t.isNotNull(), F.col("_w"))).alias("_present"), F.count(t).alias("wx_district_count"), F.max("_wt").alias("_wt"))
    day = g.groupBy(*DAY).agg(F.min(F.when(F.col("block").between(*limits.night), F.col("temp_wmean"))).alias("night_min_temp"), F.max("temp_wmean").alias("_dmax"))
    day = run_length_so_far(day, F.col("_dmax") >= limits.hot_day, ["state"], "date", "hot_day_streak")
    day = day.withColumn("prev_day_temp_wmax", day_lag("_dmax", 1, ST)).drop("_dmax")
    return g.join(day, DAY).withColumn("wx_weight_coverage", F.col("_present") / F.col("_wt")).drop("_present", "_wt")


def weighted_by_location(long: DataFrame, weights: DataFrame, columns: Sequence[str] = WEATHER) -> DataFrame:
    """Location-weighted block means whose denominator counts every reporting location of the block."""
    j = long.join(weights.select("location", F.col("weight").alias("_w")), "location")
    return j.groupBy(*KEY).agg(*[F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("_w")), F.sum("_w")).alias(c) for c in columns], F.count(F.lit(1)).alias("locations"))


def correlation_weights(df: DataFrame, feature: str, method: str = "softmax", keys: Sequence[str] = ("state", "month"), sign: int = 1, shrink: float = 0.05) -> DataFrame:
    """Weights of the locations of a group from their correlation with load; they sum to 1.

    softmax: exp of the signed correlation, shrunk toward equal; abs: |r|; clip: the part with the expected sign;
    hybrid: as clip, wrong signs count a fifth; mean: equal over locations that have a correlation.
    ``df`` holds keys, location, feature and load. All-zero groups fall back to equal weights.
    """
    c = df.groupBy(*keys, "location").agg(pearson(feature, "load").alias("r"))
    c = join_stats(c, keys, _n=F.count(F.lit(1)))
    r = F.coalesce("r", F.lit(0.0)) * sign
    raw = {"softmax": F.exp(F.least(F.greatest(r, F.lit(-3.0)), F.lit(3.0))) * (1 - shrink) + shrink / F.col("_n"), "abs": F.abs(r),
           "clip": F.greatest(r, F.lit(0.0)), "hybrid": F.when(r < 0, F.abs(r) * 0.2).otherwise(r), "mean": F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)}[method]
    c = join_stats(c.withColumn("_raw", raw), keys, _s=F.sum("_raw"))
    w = F.when(F.col("_s") > 0, F.col("_raw") / F.col("_s")).otherwise(1.0 / F.col("_n"))
    return c.withColumn("weight", w).select(*keys, "location", "r", "weight")


def correlation_weighted(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("state", "month"), method: str = "softmax") -> DataFrame:
    """State weather by correlation weights, one weight set per (group, feature). The weight table has locations x groups rows."""
    out = None
    for f in features:
        w = correlation_weights(df, f, method, keys)
        g = df.join(w.select(*keys, "location", "weight"), [*keys, "location"]).groupBy(*KEY).agg(weighted_avg(f, "weight").alias(f"{f}_cw"))
        out = g if out is None else out.join(g, KEY, "full_outer")
    return out


@dataclass(frozen=True)
class EventLimits:
    """Alert thresholds and rough MW effects of weather events."""
    rain_avg: float = 3.0
    heavy_rain_avg: float = 8.0
    heavy_rain_peak: float = 15.0
    wind: float = 25.0
    gust: float = 40.0
    heat: float = 42.0
    cold: float = 8.0
    severe_cold: float = 4.0
    dust_wind: float = 25.0
    dust_cloud_rise: float = 30.0
    dust_radiation_drop: float = 40.0
    dust_humidity_rise: float = 20.0
    dust_window: int = 8
    rain_mw: float = -80.0
    wind_mw: float = -5.0
    heat_mw: float = 60.0
    cold_mw: float = -40.0


def day_events(df: DataFrame, limits: EventLimits = EventLimits()) -> DataFrame:
    """Event flags per day, severity, MW impact and the tolerances that follow from the severity.

    Missing weather counts as mild (25 C, 50 %, no rain or wind). The dust flag needs wind, a rise of cloud and of
    humidity and a fall of radiation within one window of blocks.
    """
    k = limits
    d = df.select(*DAY, "block", *[F.coalesce(c, F.lit(v)).alias(a) for a, c, v in (
        ("t", "temperature", 25.0), ("p", "precipitation", 0.0), ("w", "wind_speed_10m", 0.0), ("c", "cloud_cover", 0.0), ("r", "direct_radiation", 0.0), ("h", "humidity", 50.0))])
    day = Window.partitionBy(*DAY).orderBy("block")
    lag = lambda c: F.lag(c).over(day)
    d = d.withColumns({"dc": F.coalesce(F.col("c") - lag("c"), F.lit(0.0)), "dh": F.coalesce(F.col("h") - lag("h"), F.lit(0.0)),
                       "dr": F.coalesce(F.when(lag("r") > 10, (lag("r") - F.col("r")) / lag("r") * 100.0), F.lit(0.0)),
                       "rn": F.row_number().over(day), "n": F.count(F.lit(1)).over(Window.partitionBy(*DAY))})
    ahead = day.rowsBetween(0, k.dust_window - 1)
    hit = ((F.max("w").over(ahead) >= k.dust_wind) & (F.max("dc").over(ahead) >= k.dust_cloud_rise) & (F.max("dr").over(ahead) >= k.dust_radiation_drop)
           & (F.max("dh").over(ahead) >= k.dust_humidity_rise) & (F.col("rn") <= F.col("n") - k.dust_window))
    d = d.withColumn("dust", hit)
    a = d.groupBy(*DAY).agg(
        F.avg("p").alias("rain_avg"), F.max("p").alias("rain_peak"), F.max("w").alias("wind_max"), F.max("t").alias("temp_max"), F.min("t").alias("temp_min"), F.bool_or("dust").alias("dust_storm"),
        F.min(F.when(F.col("dust"), F.col("rn"))).alias("dust_start"), count_where(F.col("p") > 1).alias("rain_blocks"), count_where(F.col("w") >= k.wind).alias("wind_blocks"),
        count_where(F.col("t") >= k.heat).alias("heat_blocks"), count_where(F.col("t") <= k.cold).alias("cold_blocks"))
    a = a.withColumns({
        "rain": F.col("rain_avg") >= k.rain_avg, "heavy_rain": (F.col("rain_avg") >= k.heavy_rain_avg) | (F.col("rain_peak") >= k.heavy_rain_peak),
        "wind": F.col("wind_max") >= k.wind, "gusty": F.col("wind_max") >= k.gust, "heat": F.col("temp_max") >= k.heat, "cold": F.col("temp_min") <= k.cold,
        "severe_cold": F.col("temp_min") <= k.severe_cold})
    z = F.lit(0.0)
    impact = (F.when(F.col("rain"), k.rain_mw * F.col("rain_avg")).otherwise(z) + F.when(F.col("wind"), k.wind_mw * (F.col("wind_max") - k.wind)).otherwise(z)
              + F.when(F.col("heat"), k.heat_mw * (F.col("temp_max") - k.heat)).otherwise(z) + F.when(F.col("cold"), k.cold_mw * (k.cold - F.col("temp_min"))).otherwise(z))
    high = F.col("heavy_rain") | F.col("gusty") | F.col("heat") | F.col("severe_cold") | F.col("dust_storm")
    sev = F.when(F.col("heavy_rain") & F.col("gusty"), "CRITICAL").when(high, "HIGH").when(F.col("rain") | F.col("wind") | F.col("cold"), "MEDIUM").otherwise("NONE")
    text = F.concat_ws(" + ", F.when(F.col("heavy_rain"), "Heavy rain").when(F.col("rain"), "Rain"), F.when(F.col("gusty"), "Gusty winds").when(F.col("wind"), "Strong winds"),
                       F.when(F.col("heat"), "Extreme heat"), F.when(F.col("severe_cold"), "Severe cold").when(F.col("cold"), "Cold"), F.when(F.col("dust_storm"), "Dust storm"))
    a = a.withColumn("impact_mw", impact).withColumn("severity", sev).withColumn("description", F.when(text == "", "No anomaly").otherwise(text))
    s = F.col("severity")
    return a.withColumn("clamp_sigma", F.when(s == "NONE", 2.5).when(s == "MEDIUM", 3.0).when(s == "HIGH", 4.0).otherwise(5.0)).withColumn(
        "decay", F.when(s == "NONE", 0.997).when(s == "MEDIUM", 0.998).otherwise(0.999))


def weather_regime(df: DataFrame) -> DataFrame:
    """RAINY, DUSTY, PRE_MONSOON_HOT or NORMAL per day (temperature stands in for the apparent one)."""
    d = df.groupBy(*DAY).agg(F.avg("precipitation").alias("p"), F.max("precipitation").alias("px"), F.max("temperature").alias("tx"), F.avg("humidity").alias("h"),
                             F.max("wind_speed_10m").alias("w"), F.avg("cloud_cover").alias("c"))
    r = (F.when((F.col("p") > 1) | (F.col("px") > 5), "RAINY").when((F.col("tx") > 42) & (F.col("h") < 35) & (F.col("w") > 25), "DUSTY")
         .when((F.col("tx") > 42) | ((F.col("tx") > 40) & (F.col("h") < 45)), "PRE_MONSOON_HOT").when((F.col("c") > 75) & (F.col("w") > 25), "DUSTY").otherwise("NORMAL"))
    return d.withColumn("regime", r)


# Coefficients of the heat-index polynomial in temperature (C) and humidity (%).
HEAT_INDEX = (-8.78, 1.611, 2.338, -0.146, -0.0123, -0.0164, 0.00221, 0.000725, -0.00000358)


def heat_index_polynomial(t: Column | str, h: Column | str) -> Column:
    t, h = F.col(t) if isinstance(t, str) else t, F.col(h) if isinstance(h, str) else h
    k = HEAT_INDEX
    return k[0] + k[1] * t + k[2] * h + k[3] * t * h + k[4] * t * t + k[5] * h * h + k[6] * t * t * h + k[7] * t * h * h + k[8] * t * t * h * h


def storm_days(df: DataFrame, rain: float = 15.0, wind: float = 35.0) -> DataFrame:
    d = df.groupBy(*DAY).agg(F.sum("precipitation").alias("rain_sum"), F.max("wind_speed_10m").alias("wind_max"))
    return d.withColumn("storm", F.coalesce((F.col("rain_sum") > rain) | (F.col("wind_max") > wind), F.lit(False)))


def storm_profile(df: DataFrame, days: DataFrame) -> DataFrame:
    """Mean load of storm days and of clear days per block, and the suppression."""
    j = df.join(days.select(*DAY, "storm"), DAY)
    p = j.groupBy("state", "block").agg(avg_where(F.col("storm"), "load").alias("storm_load"), avg_where(~F.col("storm"), "load").alias("clear_load"))
    return p.withColumn("suppression", F.col("clear_load") - F.col("storm_load"))


def storm_events(df: DataFrame, days: DataFrame, limit: float = 300.0) -> DataFrame:
    """Onset block, largest suppression and duration of each storm day against the clear profile."""
    prof = storm_profile(df, days).select("state", "block", "clear_load")
    j = df.join(days.where("storm").select(*DAY), DAY).join(prof, ["state", "block"]).withColumn("drop", F.col("clear_load") - F.col("load"))
    e = j.groupBy(*DAY).agg(F.min(F.when(F.col("drop") > limit, F.col("block"))).alias("onset_block"), F.max("drop").alias("max_suppression"),
                            count_where(F.col("drop") > limit).alias("duration_blocks"), F.max("block").alias("_last"))
    return e.withColumn("recovery_blocks", F.coalesce(F.col("_last") - F.col("onset_block"), F.lit(0))).drop("_last")


def monsoon_onset(daily: DataFrame, limit: float = 25.0, days: int = 5, value: str = "rain") -> DataFrame:
    """First date of each year whose rain over the last days on record exceeds the limit."""
    d = daily.withColumn("year", F.year("date"))
    w = Window.partitionBy("state", "year").orderBy("date").rowsBetween(-(days - 1), 0)
    d = d.withColumn("rolling_rain", F.when(F.count(value).over(w) >= 3, F.sum(value).over(w)))
    return d.groupBy("state", "year").agg(F.min(F.when(F.col("rolling_rain") > limit, F.col("date"))).alias("onset"), F.max("rolling_rain").alias("max_rolling"))


def impact_context(df: DataFrame) -> DataFrame:
    """Impact regime of each day, rainy days so far in its month, and the first-rain flag."""
    d = df.groupBy(*DAY).agg(F.avg("temperature").alias("t"), F.avg("humidity").alias("h"), F.sum("precipitation").alias("rain"), F.avg("cloud_cover").alias("c"))
    regime = F.when((F.col("t") > 38) & (F.col("h") < 40), "hot_dry").when((F.col("rain") > 5) | ((F.col("h") > 65) & (F.col("c") > 60)), "active_monsoon").otherwise("pre_monsoon_humid")
    month = Window.partitionBy("state", F.trunc("date", "month")).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("regime", regime).withColumn("rainy_days", F.coalesce(F.sum(F.when(F.col("rain") > 5, 1).otherwise(0)).over(month), F.lit(0)))
    y = day_lag("rain", 1, ST)
    return d.withColumn("yday_rain", y).withColumn("first_rain", F.coalesce((F.col("rain") > 5) & (F.col("yday_rain") < 1), F.lit(False))).withColumn(
        "first_rain_event", F.coalesce((F.col("rain") > 5) & (F.col("yday_rain") <= 1) & (F.col("rainy_days") == 0), F.lit(False)))


def capped_rain_delta(df: DataFrame) -> DataFrame:
    """Rain change to the day before per block, within +-3 mm on a first-rain day and +-10 mm otherwise."""
    ctx = impact_context(df).select(*DAY, "first_rain")
    j = df.withColumn("_d", F.col("precipitation") - day_lag("precipitation", 1)).join(ctx, DAY)
    cap = F.when(F.col("first_rain"), 3.0).otherwise(10.0)
    return j.withColumn("rain_delta", F.when(F.col("_d").isNotNull(), F.least(F.greatest(F.col("_d"), -cap), cap))).drop("_d")


def fill_weather(target: DataFrame, weather: DataFrame, proxy: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weather of the target blocks: the delivered value, else the climatological proxy of the block."""
    w = weather.select(*KEY, *[F.col(c).alias(f"_w_{c}") for c in columns])
    p = proxy.select("state", "block", *[F.col(c).alias(f"_p_{c}") for c in columns])
    j = target.select(*KEY).join(w, KEY, "left").join(p, ["state", "block"], "left")
    return j.select(*KEY, *[F.coalesce(f"_w_{c}", f"_p_{c}").alias(c) for c in columns])


def climate_proxy(df: DataFrame, date: str, columns: Sequence[str], last_dates: int = 60, min_days: int = 3) -> DataFrame:
    """Block means over the latest same-season dates before a date, within one weekday of it when enough of them exist."""
    d = F.lit(date).cast("date")
    season = lambda c: F.floor(F.pmod(F.month(c), F.lit(12)) / 3)
    h = df.where((F.col("date") < d) & (season("date") == season(d)))
    days = h.select(*DAY).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= last_dates)
    gap = F.pmod(F.weekday("date") - F.weekday(d) + 7, F.lit(7))
    days = days.withColumn("_near", gap.isin(0, 1, 6))
    days = join_stats(days, ["state"], _k=count_where(F.col("_near")))
    days = days.where((F.col("_k") < min_days) | F.col("_near"))
    return h.join(days.select(*DAY), DAY, "left_semi").groupBy("state", "block").agg(*[F.avg(c).alias(c) for c in columns])


# MW per saturated unit of rain and of wind by season, evening rain factor, peak-hour wind factor.
RAIN_MW = {"winter": 15.0, "spring": 18.0, "summer": 25.0, "fall": 20.0}
WIND_MW = {"winter": 8.0, "spring": 10.0, "summer": 12.0, "fall": 10.0}


def saturations(df: DataFrame, season: str, gust: float = 30.0) -> DataFrame:
    """Log-saturated rain and wind effects per block in MW, and the normalised solar index."""
    import math
    b = F.col("block")
    rain = F.when(F.col("precipitation") > 0, F.log1p("precipitation") * (5.0 / math.log1p(5.0))).otherwise(0.0) * RAIN_MW[season] * F.when(b >= 70, 1.8).otherwise(1.0)
    wind = F.log1p(F.greatest(F.lit(0.0), F.coalesce("wind_speed_10m", F.lit(0.0)) - gust)) / math.log1p(30.0) * WIND_MW[season] * F.when(b.between(33, 76), 1.5).otherwise(1.0)
    j = join_stats(df, ["state"], _mx=F.greatest(F.max("direct_radiation"), F.lit(1.0)))
    sol = F.greatest(F.coalesce("direct_radiation", F.lit(0.0)), F.lit(0.0)) / F.col("_mx") * (1 - F.coalesce("cloud_cover", F.lit(50.0)) / 100.0)
    return j.withColumns({"rain_impact": rain, "wind_impact": wind, "solar_index": sol}).drop("_mx")


def evening_storm(df: DataFrame, forecast: str, wind: float = 25.0, rain: float = 2.0, mw_per_kmh: float = 60.0, cap: float = 2000.0, settled: int = 0) -> DataFrame:
    """Cut of blocks 73..88, fading to half, when wind of blocks 69..76 and rain of blocks 69..88 announce a storm."""
    b = F.col("block")
    d = df.groupBy(*DAY).agg(avg_where(b.between(69, 76), "wind_speed_10m").alias("pre_wind"), F.sum(F.when(b.between(69, 88), F.col("precipitation"))).alias("pre_rain"))
    cut = F.when((F.col("pre_wind") > wind) & (F.col("pre_rain") > rain), F.least(mw_per_kmh * (F.col("pre_wind") - wind), F.lit(cap))).otherwise(0.0)
    j = df.join(d.withColumn("cut_mw", cut), DAY)
    taper = F.when(b.between(73, 88) & (b > settled), 1.0 - 0.5 * (b - 73) / 15.0).otherwise(0.0)
    return j.withColumn("adjustment", -F.col("cut_mw") * taper).withColumn("adjusted", F.when(taper > 0, nonneg(F.col(forecast) + F.col("adjustment"))).otherwise(F.col(forecast)))


def weighted_or_mean(long: DataFrame, weights: DataFrame, mean: DataFrame, columns: Sequence[str], min_blocks: int = 10) -> DataFrame:
    """Location-weighted day weather; days with too few weighted blocks fall back to the state mean."""
    w = weighted_by_location(long, weights, columns)
    n = w.groupBy(*DAY).agg(F.count(F.lit(1)).alias("_nb"))
    j = mean.select(*KEY, *[F.col(c).alias(f"_m_{c}") for c in columns]).join(w.select(*KEY, *columns), KEY, "left").join(n, DAY, "left")
    use = F.coalesce(F.col("_nb") >= min_blocks, F.lit(False))
    return j.select(*KEY, *[F.when(use, F.coalesce(c, f"_m_{c}")).otherwise(F.col(f"_m_{c}")).alias(c) for c in columns], use.alias("weighted"))


def mean_temperature_gap(df: DataFrame) -> DataFrame:
    """Absolute difference between a day's mean temperature and that of its baseline days."""
    d = df.groupBy(*DAY).agg(F.avg("temperature").alias("t"), F.avg("n_temp").alias("b"))
    return d.select(*DAY, F.coalesce(F.abs(F.col("t") - F.col("b")), F.lit(0.0)).alias("deviation"))


def abnormal_factor(ctx: DataFrame) -> Column:
    """Text of the abnormal factors of a day against its trailing week."""
    def factor(name: str, value: str, limit: float, rise: float, unit: str) -> Column:
        v, d = F.col(value), F.col(f"{value}_delta")
        hit = (v >= limit) | F.coalesce(d >= rise, F.lit(False))
        return F.when(hit, F.concat(F.format_string(f"{name} abnormality: %.1f{unit}", F.round(v + 1e-9, 1)), F.when(d.isNotNull(), F.format_string(", %+.1f vs trailing 7d", F.round(d + 1e-9, 1))).otherwise(""), F.lit(".")))
    text = F.concat_ws(" ", factor("Heat", "temp_max", 38.0, 3.0, "C"), factor("Humidity", "hum_mean", 70.0, 8.0, "%%"), factor("Heat-index", "heat_proxy", 60.0, 7.0, ""),
                       factor("Rain", "rain_sum", 1.0, 1.0, " mm"), factor("Wind", "wind_max", 18.0, 5.0, ""))
    return F.when(text == "", "No clear abnormal weather factor.").otherwise(text)


def daily_context(df: DataFrame, window: int = 7, min_days: int = 3) -> DataFrame:
    """Daily aggregates of six variables with trailing mean, delta and z score."""
    d = df.groupBy(*DAY).agg(F.avg("temperature").alias("temp_mean"), F.max("temperature").alias("temp_max"), F.avg("humidity").alias("hum_mean"),
                             F.sum("precipitation").alias("rain_sum"), F.max("wind_speed_10m").alias("wind_max"))
    d = d.withColumn("heat_proxy", F.col("temp_max") * (1.0 + F.col("hum_mean") / 100.0))
    cols = [c for c in d.columns if c not in DAY]
    w = days_ago(ST, window, 1)
    d = d.withColumns({f"{c}_avg": F.when(F.count(c).over(w) >= min_days, F.avg(c).over(w)) for c in cols}
                      | {f"{c}_sd": F.when(F.count(c).over(w) >= min_days, F.stddev_samp(c).over(w)) for c in cols})
    return d.withColumns({f"{c}_delta": F.col(c) - F.col(f"{c}_avg") for c in cols} | {f"{c}_z": ratio(F.col(c) - F.col(f"{c}_avg"), f"{c}_sd") for c in cols})
