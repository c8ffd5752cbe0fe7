"""Similar days of every target date at once.

The rules are those of ``similarity``; there one target is asked for, here all targets meet their candidates in joins of bounded
buckets. Days are numbered within their state, so "the last seven valid days" is an equality join on the number; "the same month
of earlier years" is one on (state, year, month). A target has at most 7 + 43 candidates per earlier year, and every
window below runs within one target, so no state's history is gathered anywhere.

The profile search compares each target with all earlier days of its state. Days become vectors of 288 numbers and are dealt
into blocks of 64 targets by 64 candidates; a task compares one pair of blocks and returns at most k days per target.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import avg_where, count_where
from quarterhour.operators.anomaly import day_anomalies
from quarterhour.operators.similarity import DAY, DEGREE_BASES, HOLIDAY_POOL, RECENCY_BOOST, TIER_WEIGHTS, VARS, WEEKEND_POOL, WEEKENDS_BACK, WEIGHTED
from quarterhour.sources.stage import shared

RECENT = 7
TARGET = ["state", "target"]
BASES = list(dict.fromkeys(DEGREE_BASES.values()))
DAYS_TOGETHER, BLOCKS = 64, 96


def season_base(date: Column | str) -> Column:
    """Place in BASES of a date's season."""
    place = {s: BASES.index(b) for s, b in DEGREE_BASES.items()}
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), place["winter"]).when(m < 6, place["spring"]).when(m < 9, place["summer"]).otherwise(place["fall"])


def day_features(df: DataFrame) -> DataFrame:
    """Level and weather of each day, with degrees above and below the bases of every season (arrays in the order of BASES)."""
    flags = [F.max(F.col(c).cast("int")).alias(c) for c in ("is_holiday", "synthetic") if c in df.columns]
    over = lambda c: F.avg(F.greatest(F.col("temperature") - c, F.lit(0.0)))
    under = lambda c: F.avg(F.greatest(c - F.col("temperature"), F.lit(0.0)))
    return df.groupBy(*DAY).agg(*flags, F.avg("load").alias("level"), F.avg("temperature").alias("t"), F.avg("humidity").alias("h"), F.array(*[over(c) for c, _ in BASES]).alias("cdd"),
                                F.array(*[under(h) for _, h in BASES]).alias("hdd"), F.max(F.when(F.col("precipitation") > 0, 1).otherwise(0)).alias("rain"), F.max("wind_speed_10m").alias("wind"))


def numbered(day: DataFrame, min_level: float) -> DataFrame:
    """valid, order (number of the day among the valid ones), before (valid days before it) and weekday_order, within the state."""
    by_date = Window.partitionBy("state").orderBy("date")
    valid = F.coalesce(F.col("level") > min_level, F.lit(False))
    d = day.withColumns({x: F.lit(0) for x in ("is_holiday", "synthetic") if x not in day.columns}).withColumn("valid", valid)
    d = d.withColumn("order", F.sum(F.col("valid").cast("int")).over(by_date.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumns({"before": F.col("order") - F.col("valid").cast("int"), "weekday_order": F.row_number().over(Window.partitionBy("state", F.weekday("date")).orderBy("date")), "first_year": F.min(F.year("date")).over(Window.partitionBy("state"))})


def candidate_pairs(days: DataFrame, start: str | None, end: str | None, window_days: int) -> DataFrame:
    """A row per target and candidate: the target's columns with ``_`` in front, the candidate's as they are, pool and age
    (1 for the latest valid day before the target)."""
    t = days.where(F.col("date") >= F.lit(start).cast("date")) if start else days
    t = t.where(F.col("date") <= F.lit(end).cast("date")) if end else t
    t = t.select("state", F.col("date").alias("target"), "first_year", *[F.col(c).alias(f"_{c}") for c in ("t", "h", "cdd", "hdd", "rain", "wind", "is_holiday", "before", "weekday_order")])
    c = days.where("valid").select("state", "date", "level", "t", "h", "cdd", "hdd", "rain", "wind", "is_holiday", "synthetic", "order", "weekday_order")
    latest = t.withColumn("age", F.explode(F.sequence(F.lit(1), F.lit(RECENT)))).withColumn("order", F.col("_before") - F.col("age") + 1)
    recent = latest.join(c, ["state", "order"]).withColumn("pool", F.lit("recent_7"))
    years = F.when(F.col("first_year") < F.year("target"), F.sequence("first_year", F.year("target") - 1))
    earlier = t.withColumn("_y", F.explode(years)).withColumn("_m", F.month("target"))
    same_md = F.make_date(F.col("_y"), F.col("_m"), F.least(F.dayofmonth("target"), F.lit(28)))
    month = earlier.join(c.withColumns({"_y": F.year("date"), "_m": F.month("date")}), ["state", "_y", "_m"]).where(F.abs(F.datediff("date", same_md)) <= window_days)
    month = month.withColumn("age", F.col("_before") - F.col("order") + 1).where(F.col("age") > RECENT).withColumn("pool", F.lit("current_month")).drop("_y", "_m")
    return recent.unionByName(month).drop("first_year", "order", "_before")


def over_target(df: DataFrame, **aggs: Column) -> DataFrame:
    w = Window.partitionBy(*TARGET)
    return df.withColumns({n: c.over(w) for n, c in aggs.items()})


def similar_day_pools(day: DataFrame, start: str | None = None, end: str | None = None, top: int = 8, window_days: int = 21, gust: float = 30.0, min_level: float = 100.0,
                      weights: tuple[float, float] = (0.55, 0.25), anomaly_limit: float = 0.06, min_clean: int = 5) -> DataFrame:
    """For every date between start and end: its similar days, with pool, tier, score, rank, scale and weight.

    ``day`` is the table of ``day_features`` of this module; the rules are stated at ``similarity.similar_day_pool``.
    """
    days = shared(numbered(day, min_level))
    pairs = shared(candidate_pairs(days, start, end, window_days))
    dow, weekend = F.weekday("date"), F.weekday("target") >= 5
    same = (dow == F.weekday("target")) & (F.col("_weekday_order") - F.col("weekday_order") <= WEEKENDS_BACK)
    c = over_target(pairs.withColumn("_same", same), _nh=count_where(F.col("is_holiday") == 1), _nw=count_where(F.col("_same")))
    own_type = F.when(F.col("_is_holiday") == 1, (F.col("_nh") < HOLIDAY_POOL) | (F.col("is_holiday") == 1)).when(weekend, (F.col("_nw") < WEEKEND_POOL) | F.col("_same")).otherwise(True)
    c = c.where(own_type & (F.coalesce("synthetic", F.lit(0)) == 0))
    bad = day_anomalies(day.select(*DAY, F.col("level").alias("load")), anomaly_limit).where("excluded").select(*DAY, F.lit(1).alias("_x"))
    c = over_target(c.join(bad, DAY, "left"), _ok=count_where(F.col("_x").isNull()))
    c = c.where((F.col("_ok") < min_clean) | F.col("_x").isNull())
    calm_target = (F.col("_rain") == 0) & (F.coalesce("_wind", F.lit(0.0)) <= gust)
    calm = (F.col("rain") == 0) & (F.coalesce("wind", F.lit(0.0)) <= gust)
    c = over_target(c.withColumn("_calm", calm), _nc=count_where(F.col("_calm")))
    c = c.where(~calm_target | (F.col("_nc") == 0) | F.col("_calm"))
    base = season_base("target")
    apart = lambda x: F.abs(F.get(x, base) - F.get(f"_{x}", base))
    c = c.withColumns({"dt": F.abs(F.col("t") - F.col("_t")), "dh": F.abs(F.col("h") - F.col("_h")), "dd": apart("cdd") + apart("hdd")})
    c = over_target(c, **{f"_s{x}": F.stddev_pop(x) for x in ("dt", "dh", "dd")})
    unit = lambda x: F.coalesce(F.col(x), F.lit(0.0)) / F.when(F.col(f"_s{x}") > 1e-9, F.col(f"_s{x}")).otherwise(1.0)
    score = weights[0] * 0.7 * unit("dt") + weights[0] * 0.3 * unit("dd") + weights[1] * unit("dh")
    tier = F.when(dow == F.weekday("target"), 0).when((dow >= 5) == weekend, 1)
    c = c.withColumn("score", score).withColumn("tier", tier).where(F.col("tier").isNotNull())
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy(*TARGET).orderBy("tier", F.round("score", 9), F.desc("date")))).where(F.col("rank") <= top)

    recent = over_target(pairs.where("pool = 'recent_7'").select(*TARGET, "date", "level"), _m=F.avg("level"), _s=F.stddev_samp("level"), _n=F.count(F.lit(1)))
    recent = recent.withColumn("_cl", F.when((F.col("_n") >= 3) & (F.col("_s") > 0), F.abs(F.col("level") - F.col("_m")) <= 1.8 * F.col("_s")).otherwise(True))
    recent = over_target(recent, _k=count_where(F.col("_cl"))).withColumn("_cl", F.col("_cl") | (F.col("_k") < 2))
    recent = over_target(recent, _lvl=avg_where(F.col("_cl"), "level"))
    # Every target with a candidate has a latest valid day, so its level is found there; _cl says whether a day is a clean recent one.
    levels = recent.groupBy(*TARGET).agg(F.max("_lvl").alias("_lvl"), F.collect_set(F.when(F.col("_cl"), F.col("date"))).alias("_clean"))
    c = c.join(levels, TARGET, "left")
    scale = F.coalesce(F.least(F.greatest(F.col("_lvl") / F.col("level"), F.lit(0.70)), F.lit(1.50)), F.lit(1.0))
    tier_weight = F.element_at(F.array(*[F.lit(x) for x in TIER_WEIGHTS]), F.col("tier") + 1)
    weight = tier_weight * F.when((F.col("pool") == "recent_7") & F.array_contains("_clean", F.col("date")), RECENCY_BOOST).otherwise(1.0)
    return c.select(*TARGET, "date", "pool", "tier", "score", "rank", scale.alias("scale"), weight.alias("weight"))


def similar_day_baselines(df: DataFrame, pools: DataFrame) -> DataFrame:
    """Per target and block: weighted mean of the scaled similar days. A chosen day's rows are sent to the targets that chose it."""
    j = df.select(*DAY, "block", "load").join(pools.select(*TARGET, "date", "scale", "weight"), DAY)
    v = F.col("load") * F.col("scale")
    return j.groupBy(*TARGET, "block").agg(F.try_divide(F.sum(v * F.col("weight")), F.sum(F.when(v.isNotNull(), F.col("weight")))).alias("baseline"), F.count(F.lit(1)).alias("days"))


# --- weather profiles --------------------------------------------------------------------------------------------


def profiles(df: DataFrame) -> DataFrame:
    """state, date, n (number of the day in its state), profile (a vector of 96 values per variable) and, per variable, the
    mean and deviation of all earlier days."""
    slots = [F.array_sort(F.collect_list(F.when(F.col(v).isNotNull(), F.struct("block", F.col(v).cast("double").alias("v"))))).alias(f"_{v}") for v in VARS]
    sums = [x for v in VARS for x in (F.count(v).alias(f"_n_{v}"), F.sum(v).alias(f"_t_{v}"), F.sum(F.col(v) * F.col(v)).alias(f"_q_{v}"))]
    daily = df.groupBy(*DAY).agg(*slots, *sums)
    before = Window.partitionBy("state").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    mean, spread = {}, {}
    for v in VARS:
        n, t, q = (F.sum(f"_{x}_{v}").over(before) for x in "ntq")
        mean[v] = t / n
        spread[v] = F.sqrt(F.greatest(q / n - (t / n) * (t / n), F.lit(0.0)))
    return daily.select(*DAY, (F.row_number().over(Window.partitionBy("state").orderBy("date")) - 1).alias("n"), *[F.col(f"_{v}").alias(v) for v in VARS], F.array(*mean.values()).alias("means"), F.array(*spread.values()).alias("spreads"))


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    """Days x variables x blocks, with NaN where a block has no value."""
    out = np.full((len(pdf), len(VARS), BLOCKS), np.nan)
    for i, row in enumerate(zip(*[pdf[v] for v in VARS])):
        for j, values in enumerate(row):
            for x in values:
                out[i, j, x["block"] - 1] = x["v"]
    return out


def _distances(target: np.ndarray, days: np.ndarray, mean: np.ndarray, spread: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Distance and share of comparable values of one profile to several."""
    unit = np.where(np.nan_to_num(spread) > 1e-9, spread, 1.0)[:, None]
    a, b = (days - mean[:, None]) / unit, (target - mean[:, None]) / unit
    ok = ~np.isnan(a) & ~np.isnan(b)
    a, b = np.where(ok, a, 0.0), np.where(ok, b, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        if method == "cosine":
            norm = np.sqrt((b * b).sum((1, 2)) * (a * a).sum((1, 2)))
            d = 1.0 - np.where(norm > 0, (a * b).sum((1, 2)) / norm, 0.0)
        else:
            w = np.array([WEIGHTED[v] if method == "weighted" else 1.0 for v in VARS])[:, None]
            total = (w * ok).sum((1, 2))
            d = np.where(total > 0, np.sqrt((w * (a - b) ** 2).sum((1, 2)) / total), np.nan)
    return d, ok.sum((1, 2)) / (BLOCKS * len(VARS))


def similar_profiles(df: DataFrame, start: str | None = None, end: str | None = None, method: str = "euclidean", k: int = 5, min_coverage: float = 0.5) -> DataFrame:
    """The k earlier days with the closest weather profile, for every date between start and end: state, target, date, distance,
    coverage, rank. Variables are standardised over the days before the target, whose sums are running ones."""
    days = shared(profiles(df).withColumn("c_part", F.floor(F.col("n") / DAYS_TOGETHER).cast("int")))
    t = days.where(F.col("date") >= F.lit(start).cast("date")) if start else days
    t = t.where(F.col("date") <= F.lit(end).cast("date")) if end else t
    t = t.withColumnRenamed("c_part", "t_part").withColumn("c_part", F.explode(F.sequence(F.lit(0), F.col("t_part"))))
    last = days.groupBy("state").agg(F.max("c_part").alias("_last"))
    c = days.join(last, "state").withColumn("t_part", F.explode(F.sequence("c_part", "_last"))).select(*[F.col(x).alias(x) for x in (*DAY, "n", *VARS, "c_part", "t_part")])  # columns of their own, apart from the targets'
    key = ["state", "t_part", "c_part"]

    def compare(key_: tuple, targets: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if targets.empty or candidates.empty:
            return pd.DataFrame(columns=["state", "target", "date", "distance", "coverage"])
        candidates = candidates.sort_values("date")
        own, vectors, dates = _vectors(targets), _vectors(candidates), candidates["date"].to_numpy()
        found = []
        for i, r in enumerate(targets.itertuples(index=False)):
            earlier = int(np.searchsorted(dates, r.date))
            if not earlier:
                continue
            d, share = _distances(own[i], vectors[:earlier], np.array(r.means, float), np.array(r.spreads, float), method)
            at = np.flatnonzero((share >= min_coverage) & ~np.isnan(d))
            best = at[np.lexsort((at, np.round(d[at], 9)))][:k]
            found.append(pd.DataFrame({"state": r.state, "target": r.date, "date": dates[best], "distance": d[best], "coverage": share[best]}))
        return pd.concat(found) if found else pd.DataFrame(columns=["state", "target", "date", "distance", "coverage"])

    near = t.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(compare, "state string, target date, date date, distance double, coverage double")
    best = F.row_number().over(Window.partitionBy(*TARGET).orderBy(F.round("distance", 9), "date"))
    return near.withColumn("rank", best).where(F.col("rank") <= k).withColumn("day_of_week", F.date_format("date", "EEEE"))


def load_changes(similar: DataFrame, load: DataFrame) -> DataFrame:
    """Mean load of each similar day against that of its target."""
    m = load.groupBy(*DAY).agg(F.avg("load").alias("avg_load"))
    t = m.select("state", F.col("date").alias("target"), F.col("avg_load").alias("_t"))
    return similar.join(m, DAY, "left").join(t, TARGET, "left").withColumn("change_pct", ratio(F.col("avg_load") - F.col("_t"), "_t") * 100).drop("_t")
