"""Similar days."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import avg_where, count_where, rank_corr_wide
from quarterhour.operators.features import join_stats

DAY = ["state", "date"]
VARS = ("temperature", "humidity", "precipitation")
WEIGHTED = {"temperature": 1.0, "humidity": 0.5, "precipitation": 0.3}


def standardise(value: str, mean: Column, sd: Column, lo: Column, hi: Column) -> Column:
    """z score, else position between minimum and maximum, else 0."""
    v = F.col(value)
    return F.when(sd > 1e-9, (v - mean) / sd).when(hi - lo > 1e-9, (v - lo) / (hi - lo)).otherwise(F.lit(0.0))


def standardised(df: DataFrame, value: str, keys: Sequence[str] = ("state",)) -> DataFrame:
    j = join_stats(df, keys, _m=F.avg(value), _s=F.stddev_pop(value), _lo=F.min(value), _hi=F.max(value))
    return j.withColumn("scaled", standardise(value, F.col("_m"), F.col("_s"), F.col("_lo"), F.col("_hi"))).drop("_m", "_s", "_lo", "_hi")


def similar_days(df: DataFrame, target: str, method: str = "euclidean", k: int = 5, min_coverage: float = 0.5) -> DataFrame:
    """The k earlier days whose weather profile is closest to that of a target day.

    Variables are standardised over the candidate days. The target day (at most 96 rows per state) meets each
    candidate's rows by block, so a candidate costs one pass over its own rows and no pair of candidates ever meets.
    """
    d = F.lit(target).cast("date")
    cand = df.where(F.col("date") < d)
    s = cand.groupBy("state").agg(*[F.avg(v).alias(f"_m_{v}") for v in VARS], *[F.stddev_pop(v).alias(f"_s_{v}") for v in VARS])
    z = lambda v: (F.col(v) - F.col(f"_m_{v}")) / F.when(F.col(f"_s_{v}") > 1e-9, F.col(f"_s_{v}")).otherwise(1.0)
    c = cand.join(s, "state").select(*DAY, "block", *[z(v).alias(f"c_{v}") for v in VARS])
    t = df.where(F.col("date") == d).join(s, "state").select("state", "block", *[z(v).alias(f"t_{v}") for v in VARS])
    j = c.join(t, ["state", "block"])
    w = WEIGHTED if method == "weighted" else dict.fromkeys(VARS, 1.0)
    zero, num, wsum, tt, cc, n = F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)
    for v in VARS:
        ok = F.col(f"c_{v}").isNotNull() & F.col(f"t_{v}").isNotNull()
        a, b = F.col(f"c_{v}"), F.col(f"t_{v}")
        if method == "cosine":
            num, tt, cc = num + F.when(ok, a * b).otherwise(zero), tt + F.when(ok, b * b).otherwise(zero), cc + F.when(ok, a * a).otherwise(zero)
        else:
            num, wsum = num + F.when(ok, w[v] * (a - b) * (a - b)).otherwise(zero), wsum + F.when(ok, w[v]).otherwise(zero)
        n = n + ok.cast("int")
    g = j.groupBy(*DAY).agg(F.sum(num).alias("_num"), F.sum(wsum).alias("_w"), F.sum(tt).alias("_t"), F.sum(cc).alias("_c"), F.sum(n).alias("_n"))
    dist = 1.0 - F.coalesce(ratio("_num", F.sqrt(F.col("_t") * F.col("_c"))), zero) if method == "cosine" else F.sqrt(ratio("_num", "_w"))
    g = g.withColumn("distance", dist).withColumn("coverage", F.col("_n") / (96.0 * len(VARS))).where((F.col("coverage") >= min_coverage) & F.col("distance").isNotNull())
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("state").orderBy(F.round("distance", 9), "date"))).where(F.col("rank") <= k).select(
        *DAY, "distance", "coverage", "rank", F.date_format("date", "EEEE").alias("day_of_week"))


def load_change_of(similar: DataFrame, load: DataFrame, target: str) -> DataFrame:
    """Mean load of each similar day against that of the target day."""
    m = load.groupBy(*DAY).agg(F.avg("load").alias("avg_load"))
    t = m.where(F.col("date") == F.lit(target).cast("date")).select("state", F.col("avg_load").alias("_t"))
    return similar.join(m, DAY, "left").join(t, "state", "left").withColumn("change_pct", ratio(F.col("avg_load") - F.col("_t"), "_t") * 100).drop("_t")


def similarity_weights(df: DataFrame, date: str, prior: tuple[float, float, float] = (0.55, 0.25, 0.20), blend: float = 0.35, days: int = 120, peak: tuple[int, int] = (33, 72),
                       min_days: int = 10, min_rain_days: int = 3, rain_effect: float = 0.01) -> DataFrame:
    """Weights of temperature, humidity and rain from the size of their rank correlation with the daily load (40 % whole
    day, 60 % peak blocks), mixed with a prior; and whether rainy days must match rainy days.
    """
    h = df.where(F.col("date") < F.lit(date).cast("date"))
    keep = h.select(*DAY).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= days)
    h = h.join(keep.select(*DAY), DAY, "left_semi")

    def daily(d: DataFrame) -> DataFrame:
        return d.groupBy(*DAY).agg(F.avg("temperature").alias("t"), F.avg("humidity").alias("h"), F.max(F.when(F.col("precipitation") > 0, 1.0).otherwise(0.0)).alias("r"), F.sum("load").alias("l"))
    pairs = {"st": ("t", "l"), "sh": ("h", "l"), "sr": ("r", "l")}
    day, pk = daily(h), daily(h.where(F.col("block").between(*peak)))
    a = rank_corr_wide(day, ["state"], pairs)
    b = rank_corr_wide(pk, ["state"], {f"p{k}": v for k, v in pairs.items()}).join(pk.groupBy("state").agg(F.count(F.lit(1)).alias("_pn")), "state")
    rain = F.col("r") > 0.5
    s = day.groupBy("state").agg(F.count(F.lit(1)).alias("days"), count_where(rain).alias("rainy_days"), F.coalesce(F.abs(avg_where(rain, "l") - avg_where(~rain, "l")) / F.avg("l"), F.lit(0.0)).alias("rain_effect"))
    j = s.join(a, "state").join(b, "state")
    sig = {k: F.when(F.col("_pn") >= 10, 0.4 * F.abs(k) + 0.6 * F.abs(f"p{k}")).otherwise(F.abs(k)) for k in pairs}
    tot = sig["st"] + sig["sh"] + sig["sr"]
    use = (F.col("days") >= min_days) & (tot > 1e-9)
    out = [F.when(use, (1 - blend) * sig[k] / tot + blend * p).otherwise(p).alias(n) for (k, p, n) in zip(pairs, prior, ("w_temp", "w_humidity", "w_rain"))]
    rate = F.col("rainy_days") / F.col("days")
    match = (F.col("rainy_days") >= min_rain_days) & (F.col("days") - F.col("rainy_days") >= min_rain_days) & (F.col("rain_effect") >= rain_effect) & rate.between(0.03, 0.97)
    return j.select("state", "days", *out, "rain_effect", match.alias("require_rain_match"))


# Weights of the day tiers and the boost of clean recent days.
TIER_WEIGHTS = (1.00, 0.60, 0.30, 0.10)
RECENCY_BOOST = 1.30


# Bases of cooling and heating degrees by the season of the target.
DEGREE_BASES = {"winter": (24.0, 18.0), "spring": (22.0, 15.0), "summer": (20.0, 12.0), "fall": (22.0, 15.0)}
# Same-type days from which a target has a pool of its own, and how many weekends back that pool reaches.
HOLIDAY_POOL, WEEKEND_POOL, WEEKENDS_BACK = 3, 4, 14


def degree_bases(target: str) -> tuple[float, float]:
    month = datetime.date.fromisoformat(target).month
    return DEGREE_BASES["winter" if month in (12, 1, 2) else "spring" if month < 6 else "summer" if month < 9 else "fall"]


def day_features(df: DataFrame, cdd: float = 24.0, hdd: float = 15.0) -> DataFrame:
    """Level and weather of each day, the input of the similar-day choice (one row per day; worth storing, it is read several times)."""
    flags = [F.max(F.col(c).cast("int")).alias(c) for c in ("is_holiday", "synthetic") if c in df.columns]
    return df.groupBy(*DAY).agg(*flags,
        F.avg("load").alias("level"), F.avg("temperature").alias("t"), F.avg("humidity").alias("h"), F.avg(F.greatest(F.col("temperature") - cdd, F.lit(0.0))).alias("cdd"),
        F.avg(F.greatest(hdd - F.col("temperature"), F.lit(0.0))).alias("hdd"), F.max(F.when(F.col("precipitation") > 0, 1).otherwise(0)).alias("rain"), F.max("wind_speed_10m").alias("wind"))


def over_state(df: DataFrame, **aggs: Column) -> DataFrame:
    """Aggregates over each state's short list of days (a few dozen rows), beside the rows."""
    w = Window.partitionBy("state")
    return df.withColumns({n: c.over(w) for n, c in aggs.items()})


def similar_day_pool(day: DataFrame, target: str, top: int = 8, window_days: int = 21, gust: float = 30.0, min_level: float = 100.0,
                     weights: tuple[float, float] = (0.55, 0.25), anomaly_limit: float = 0.06, min_clean: int = 5) -> DataFrame:
    """Chosen similar days of a target date per state, with tier, score, pool, scale and weight.

    Rule set: candidates are the last seven days on record and the days of the same month within ``window_days`` of
    the same month-day in earlier years, or all earlier days if there are none; never synthetic days. A holiday keeps to
    holidays if three are among them, a weekend day to its weekday of the last 14 weeks if four are. Anomalous days (and the days after them) leave the pool if five remain. When
    the target is calm (no rain, no gusts) so must the candidates be, if any are. Score: weighted temperature, degree-day
    and humidity distance, each in units of its spread over the pool. Days are taken by tier (same weekday, same day
    type, others), then score, then recency. ``day`` is the table of ``day_features``, with the degree bases of the
    target's season.
    """
    from quarterhour.operators.anomaly import day_anomalies
    d = F.lit(target).cast("date")
    tgt = day.where(F.col("date") == d).select("state", *[F.col(c).alias(f"_{c}") for c in ("t", "h", "cdd", "hdd", "rain", "wind")])
    day = day.withColumns({x: F.lit(0) for x in ("is_holiday", "synthetic") if x not in day.columns})
    tgt = tgt.join(day.where(F.col("date") == d).select("state", F.col("is_holiday").alias("_holiday")), "state")
    weekday = F.weekday("date")
    c = day.where(F.col("date") < d).withColumn("_wr", F.row_number().over(Window.partitionBy("state", weekday).orderBy(F.desc("date")))).where(F.col("level") > min_level)
    c = c.withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date"))))
    same_md = F.make_date(F.year("date"), F.month(d), F.least(F.dayofmonth(d), F.lit(28)))
    old = (F.year("date") < F.year(d)) & (F.month("date") == F.month(d)) & (F.abs(F.datediff("date", same_md)) <= window_days)
    c = over_state(c.withColumn("pool", F.when(F.col("_r") <= 7, "recent_7").when(old, "current_month")), _np=F.count("pool"))
    c = c.where((F.col("_np") == 0) | F.col("pool").isNotNull()).withColumn("pool", F.coalesce("pool", F.lit("earlier")))
    same = (weekday == F.weekday(d)) & (F.col("_wr") <= WEEKENDS_BACK)
    c = over_state(c.join(tgt.select("state", "_holiday"), "state"), _nh=count_where(F.col("is_holiday") == 1), _nw=count_where(same))
    own_type = F.when(F.col("_holiday") == 1, (F.col("_nh") < HOLIDAY_POOL) | (F.col("is_holiday") == 1)).when(F.weekday(d) >= 5, (F.col("_nw") < WEEKEND_POOL) | same).otherwise(True)
    c = c.where(own_type & (F.coalesce("synthetic", F.lit(0)) == 0)).drop("_holiday")
    bad = day_anomalies(day.select(*DAY, F.col("level").alias("load")), anomaly_limit).where("excluded").select(*DAY, F.lit(1).alias("_x"))
    c = over_state(c.join(bad, DAY, "left"), _ok=count_where(F.col("_x").isNull()))
    c = c.where((F.col("_ok") < min_clean) | F.col("_x").isNull()).join(tgt, "state")
    calm_target = (F.col("_rain") == 0) & (F.coalesce("_wind", F.lit(0.0)) <= gust)
    calm = (F.col("rain") == 0) & (F.coalesce("wind", F.lit(0.0)) <= gust)
    c = over_state(c.withColumn("_calm", calm), _nc=count_where(F.col("_calm")))
    c = c.where(~calm_target | (F.col("_nc") == 0) | F.col("_calm"))
    c = c.withColumns({"dt": F.abs(F.col("t") - F.col("_t")), "dh": F.abs(F.col("h") - F.col("_h")), "dd": F.abs(F.col("cdd") - F.col("_cdd")) + F.abs(F.col("hdd") - F.col("_hdd"))})
    c = over_state(c, **{f"_s{x}": F.stddev_pop(x) for x in ("dt", "dh", "dd")})
    unit = lambda x: F.coalesce(F.col(x), F.lit(0.0)) / F.when(F.col(f"_s{x}") > 1e-9, F.col(f"_s{x}")).otherwise(1.0)
    score = weights[0] * 0.7 * unit("dt") + weights[0] * 0.3 * unit("dd") + weights[1] * unit("dh")
    dow, we = F.weekday("date"), F.weekday("date") >= 5
    tier = F.when(dow == F.weekday(d), 0).when(we == (F.weekday(d) >= 5), 1).otherwise(3)
    c = c.withColumn("score", score).withColumn("tier", tier).where(F.col("tier") < 3)
    rk = F.row_number().over(Window.partitionBy("state").orderBy("tier", F.round("score", 9), F.desc("date")))
    c = c.withColumn("rank", rk).where(F.col("rank") <= top)
    recent = day.where((F.col("date") < d) & (F.col("level") > min_level)).withColumn("_r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc("date")))).where(F.col("_r") <= 7)
    recent = over_state(recent, _m=F.avg("level"), _s=F.stddev_samp("level"), _n=F.count(F.lit(1)))
    recent = recent.withColumn("_cl", F.when((F.col("_n") >= 3) & (F.col("_s") > 0), F.abs(F.col("level") - F.col("_m")) <= 1.8 * F.col("_s")).otherwise(True))
    recent = over_state(recent, _k=count_where(F.col("_cl"))).withColumn("_cl", F.col("_cl") | (F.col("_k") < 2))
    lvl = recent.groupBy("state").agg(avg_where(F.col("_cl"), "level").alias("_lvl"))
    c = c.join(lvl, "state", "left").join(recent.where("_cl").select(*DAY, F.lit(1).alias("_clean")), DAY, "left")
    scale = F.coalesce(F.least(F.greatest(F.col("_lvl") / F.col("level"), F.lit(0.70)), F.lit(1.50)), F.lit(1.0))
    tw = F.element_at(F.array(*[F.lit(x) for x in TIER_WEIGHTS]), F.col("tier") + 1)
    wt = tw * F.when((F.col("pool") == "recent_7") & F.col("_clean").isNotNull(), RECENCY_BOOST).otherwise(1.0)
    return c.select(*DAY, "pool", "tier", "score", "rank", scale.alias("scale"), wt.alias("weight"))


def last_year_days(day: DataFrame, target: str, reach: int = 7) -> DataFrame:
    """Days within ``reach`` of the same month-day a year before: for observation beside the baseline, not part of it."""
    t = datetime.date.fromisoformat(target)
    anchor = F.make_date(F.lit(t.year - 1), F.lit(t.month), F.lit(min(t.day, 28)))
    near = (F.year("date") == t.year - 1) & (F.abs(F.datediff("date", anchor)) <= reach)
    return day.where(near & (F.coalesce("synthetic", F.lit(0)) == 0) if "synthetic" in day.columns else near)


def similar_day_baseline(df: DataFrame, pool: DataFrame) -> DataFrame:
    """Weighted mean of the scaled similar days per block (blocks a day lacks are left out of that block's weights)."""
    j = df.select(*DAY, "block", "load").join(pool, DAY)
    v = F.col("load") * F.col("scale")
    return j.groupBy("state", "block").agg(F.try_divide(F.sum(v * F.col("weight")), F.sum(F.when(v.isNotNull(), F.col("weight")))).alias("baseline"), F.count(F.lit(1)).alias("days"))
