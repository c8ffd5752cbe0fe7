"""Attribution of deviations to drivers, driver matrices, ranked contributors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import ratio
from quarterhour.operators.grid import day_lag
from quarterhour.operators.select import soft_edges

DAY = ["state", "date"]
# MW per unit of temperature (C), humidity (%) and rain (mm); bounds of a relative impact.
DEFAULT_MW = {"temperature": 8.0, "humidity": 2.5, "precipitation": -4.0}
IMPACT_MIN, IMPACT_MAX = -0.40, 0.50
NORMALS = {"temperature": "n_temp", "humidity": "n_hum", "precipitation": "n_rain"}


def contributions(df: DataFrame, mw: dict[str, float] | None = None) -> DataFrame:
    """MW of each weather variable: deviation from its normal times the coefficient (default where none is given)."""
    k = {**DEFAULT_MW, **(mw or {})}
    return df.withColumns({f"{c}_mw": (F.col(c) - F.col(n)) * k[c] for c, n in NORMALS.items()})


def attribution_shares(df: DataFrame) -> DataFrame:
    """Day totals per factor and their share of the weather total; unexplained = total deviation minus the parts."""
    d = contributions(df)
    a = d.groupBy(*DAY).agg(*[F.coalesce(F.sum(f"{c}_mw"), F.lit(0.0)).alias(c) for c in NORMALS], F.coalesce(F.sum(F.col("load") - F.col("baseline")), F.lit(0.0)).alias("total"))
    parts = F.col("temperature") + F.col("humidity") + F.col("precipitation")
    a = a.withColumn("_w", parts).withColumn("unexplained", F.col("total") - parts)
    den = F.when(F.abs("_w") > 1e-6, F.col("_w")).otherwise(1.0)
    items = F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("value"), (F.col(c) / den * 100).alias("pct")) for c in NORMALS],
                    F.struct(F.lit("unexplained").alias("factor"), F.col("unexplained").alias("value"), (F.col("unexplained") / den * 100).alias("pct")))
    return a.select(*DAY, F.explode(items).alias("x")).select(*DAY, "x.*")


def weather_index(df: DataFrame) -> DataFrame:
    """Deviation from the baseline in percent of the baseline."""
    return df.withColumn("wsi", F.when(F.abs("baseline") > 1e-6, (F.col("load") - F.col("baseline")) / F.abs("baseline") * 100).otherwise(0.0))


def block_attribution(df: DataFrame) -> DataFrame:
    d = contributions(df).withColumn("total_variance", F.col("load") - F.col("baseline"))
    known = sum((F.coalesce(f"{c}_mw", F.lit(0.0)) for c in NORMALS), F.lit(0.0))
    return d.withColumn("unexplained_mw", F.col("total_variance") - known)


def driver_matrix(rows: DataFrame, scenarios: DataFrame, bases: Sequence[str], soft: bool = False) -> DataFrame:
    """Final load of every scenario: baseline x (1 + clipped sum of base x slider) on the selected blocks.

    ``rows``: state, date, block, baseline and one relative base per driver (``<driver>_base``). ``scenarios``:
    scenario_id, one slider per driver (``s_<driver>``), s_weather, b_lo, b_hi (a small table written by people).
    The weather drivers (all but daytype, holiday, manual) are multiplied by s_weather too.
    """
    j = rows.crossJoin(F.broadcast(scenarios))
    human = {"daytype", "holiday", "manual"}
    total = None
    for b in bases:
        s = F.col(f"{b}_base") * F.col(f"s_{b}")
        s = s if b in human else s * F.col("s_weather")
        total = F.coalesce(s, F.lit(0.0)) if total is None else total + F.coalesce(s, F.lit(0.0))
    j = j.withColumn("impact", F.least(F.greatest(total, F.lit(IMPACT_MIN)), F.lit(IMPACT_MAX)))
    j = j.withColumn("mask", F.when(F.col("block").between(F.col("b_lo"), F.col("b_hi")), 1.0).otherwise(0.0))
    if soft:
        j = soft_edges(j.withColumn("state_only", F.col("state")).withColumn("state", F.concat_ws("|", "state", "scenario_id")), "mask", "mask_soft")
        j = j.withColumn("state", F.col("state_only")).drop("state_only").withColumn("mask", F.col("mask_soft")).drop("mask_soft")
    return j.withColumn("final_mw", F.col("baseline") * (1 + F.col("impact") * F.col("mask"))).withColumnRenamed("baseline", "baseline_mw")


def weighted_deltas(rows: DataFrame, weights: DataFrame, drivers: Sequence[str], overrides: DataFrame | None = None, deltas: dict[str, str] | None = None) -> DataFrame:
    """Relative base of each driver = override, else delta x weight of the block; impact = clipped sum.

    ``weights``: state, block, ``<driver>_weight`` (96 rows per state). ``overrides``: state, block, ``<driver>_override``.
    Deltas default to the deviation from the normal.
    """
    d = deltas or {x: NORMALS[x] for x in drivers if x in NORMALS}
    j = rows.join(weights, ["state", "block"], "left")
    if overrides is not None:
        j = j.join(F.broadcast(overrides), ["state", "block"], "left")
    total = F.lit(0.0)
    for x in drivers:
        base = (F.col(x) - F.col(d[x])) * F.col(f"{x}_weight") if x in d else F.lit(0.0)
        if overrides is not None and f"{x}_override" in overrides.columns:
            base = F.coalesce(f"{x}_override", base)
        j = j.withColumn(f"{x}_base", F.coalesce(base, F.lit(0.0)))
        total = total + F.col(f"{x}_base")
    return j.withColumn("impact", F.least(F.greatest(total, F.lit(IMPACT_MIN)), F.lit(IMPACT_MAX))).withColumn("final_mw", F.col("baseline") * (1 + F.col("impact")))


def ranked_contributors(df: DataFrame, parts: dict[str, str], baseline: str = "baseline") -> DataFrame:
    """Contributors of each block ranked by size with their shares; a block is one bounded group."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("mw")) for n, c in parts.items()])
    long = df.select(*DAY, "block", F.col(baseline).alias("_b"), F.explode(items).alias("x")).select(*DAY, "block", "_b", "x.*")
    w = Window.partitionBy(*DAY, "block")
    tot = F.sum(F.abs("mw")).over(w)
    return long.select(*DAY, "block", "feature", "mw", (F.col("mw") / F.when(tot > 0, tot).otherwise(1.0) * 100).alias("share_pct"), (ratio("mw", "_b") * 100).alias("load_pct"),
                       F.when(F.col("mw") >= 0, "up").otherwise("down").alias("direction"), F.row_number().over(w.orderBy(F.desc(F.abs("mw")), "feature")).alias("rank"))


# Action texts by risk flag and dominant family.
ACTIONS = {
    ("high", "weather"): "Increase reserve and monitor weather-driven slots.", ("high", "calendar"): "Review day-type/holiday assumptions before commitment.",
    ("high", "manual"): "Reduce manual override and apply staged correction.", ("high", "other"): "Trigger operator review and prepare corrective dispatch.",
    ("medium", "weather"): "Monitor slot and pre-position balancing support.", ("medium", "calendar"): "Monitor slot and pre-position balancing support.",
    ("medium", "other"): "Track slot and apply guarded adjustment if deviation grows.",
}


def risk_actions(df: DataFrame, families: dict[str, str], band_pct: Column, baseline: str = "baseline", final: str = "forecast") -> DataFrame:
    """Risk score (impact and band width), flag, dominant family and recommended action of each block."""
    mags = F.array(*[F.struct(F.abs(F.coalesce(F.col(c), F.lit(0.0))).alias("m"), F.lit(n).alias("n")) for n, c in families.items()])
    net = ratio(F.col(final) - F.col(baseline), F.abs(baseline)) * 100
    d = df.withColumn("net_impact_pct", F.coalesce(net, F.lit(0.0))).withColumn("dominant", F.array_max(mags)["n"])
    d = d.withColumn("risk_score", F.least(F.lit(100.0), F.abs("net_impact_pct") * 2.0 + F.coalesce(band_pct, F.lit(0.0))))
    flag = F.when(F.col("risk_score") >= 60, "high").when(F.col("risk_score") >= 30, "medium").otherwise("low")
    d = d.withColumn("risk_flag", flag)
    def pick(level: str) -> Column:
        out = None
        for (lv, fam), text in ACTIONS.items():
            if lv == level and fam != "other":
                out = F.when(F.col("dominant") == fam, text) if out is None else out.when(F.col("dominant") == fam, text)
        return out.otherwise(ACTIONS[(level, "other")])
    low = F.when(F.abs("net_impact_pct") >= 8, "Keep slot under watch; no immediate intervention.").otherwise("No action required.")
    return d.withColumn("action", F.when(F.col("risk_flag") == "high", pick("high")).when(F.col("risk_flag") == "medium", pick("medium")).otherwise(low))


def driver_shares(df: DataFrame, families: dict[str, str], after: int = 0) -> DataFrame:
    """Mean MW of each driver family over the blocks after the settled ones and its share of the total size."""
    a = df.where(F.col("block") > after).groupBy(*DAY).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for n, c in families.items()])
    tot = sum((F.abs(n) for n in families), F.lit(0.0))
    a = a.withColumn("_t", F.when(tot > 0, tot).otherwise(1.0))
    items = F.array(*[F.struct(F.lit(n).alias("driver"), F.col(n).alias("mw"), (F.col(n) / F.col("_t") * 100).alias("share_pct")) for n in families])
    return a.select(*DAY, F.explode(items).alias("x")).select(*DAY, "x.*")


def elasticity_impact(df: DataFrame, weights: DataFrame, context: DataFrame, drivers: Sequence[str], momentum: float = 0.45) -> DataFrame:
    """Day-over-day weather deltas x block weights under regime caps, plus damped day-over-day load momentum.

    ``weights``: state, block, ``<driver>_weight``; ``context``: state, date, regime, first_rain_event. Rain deltas are
    those of ``rain_delta`` when the frame has it.
    """
    b = F.col("block")
    y1, y2 = day_lag("load", 1), day_lag("load", 2)
    d = df.withColumns({f"_d_{x}": (F.col("rain_delta") if x == "precipitation" and "rain_delta" in df.columns else F.col(x) - day_lag(x, 1)) for x in drivers})
    d = d.withColumns({"_y1": y1, "_dod": y1 - y2}).join(weights, ["state", "block"], "left").join(context.select(*DAY, "regime", "first_rain_event"), DAY)
    pct = sum((F.coalesce(F.col(f"_d_{x}") * F.col(f"{x}_weight"), F.lit(0.0)) for x in drivers), F.lit(0.0))
    hot, mon, first = F.col("regime") == "hot_dry", F.col("regime") == "active_monsoon", F.col("first_rain_event")
    lo = F.when(hot, -0.18).when(mon & first, -0.10).when(mon, -0.15).otherwise(-0.18)
    hi = F.when(hot & b.between(25, 72), 0.18).when(hot, 0.12).when(mon & first, 0.08).when(mon, 0.10).otherwise(0.12)
    d = d.withColumn("impact_pct", F.least(F.greatest(pct, lo), hi))
    day = d.groupBy(*DAY).agg(F.avg(F.abs("_dod")).alias("_dev"))
    d = d.join(day, DAY)
    lam = F.when(F.col("_dev") > 150.0, min(max(momentum * 0.4, 0.15), 0.25)).otherwise(min(max(momentum, 0.3), 0.6))
    d = d.withColumn("weather_mw", F.col("_y1") * F.col("impact_pct")).withColumn("momentum_mw", lam * F.coalesce("_dod", F.lit(0.0)))
    return d.withColumn("simulated", F.col("_y1") + F.col("weather_mw") + F.col("momentum_mw")).drop("_y1", "_dod", "_dev", *[f"_d_{x}" for x in drivers])


def clean_yesterday(df: DataFrame, sigmas: float = 2.0, weeks: int = 8, min_weeks: int = 3) -> DataFrame:
    """For each day: is its total outside 2 sigma of its last same weekdays, and which latest clean same weekday replaces it."""
    d = df.groupBy(*DAY).agg(F.sum("load").alias("total")).where(F.col("total") > 0).withColumn("dow", F.weekday("date"))
    o = Window.partitionBy("state", "dow").orderBy("date")
    w = o.rowsBetween(-weeks, -1)
    d = d.withColumns({"_n": F.count("total").over(w), "mean": F.avg("total").over(w), "std": F.stddev_pop("total").over(w), "_h": F.collect_list(F.struct("date", "total")).over(w)})
    known = (F.col("_n") >= min_weeks) & (F.col("std") > 0)
    bad = F.coalesce(known & (F.abs(F.col("total") - F.col("mean")) > sigmas * F.col("std")), F.lit(False))
    ok = F.filter("_h", lambda x: F.abs(x["total"] - F.col("mean")) <= sigmas * F.col("std"))
    return d.withColumn("anomalous", bad).withColumn("replacement", F.when(bad, F.array_max(F.transform(ok, lambda x: x["date"]))).otherwise(F.col("date"))).drop("_n", "_h", "dow")
