"""Data-quality contracts and output gates. Status is ok < degraded < failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour import BLOCKS_PER_DAY
from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import count_where
from quarterhour.operators.grid import day_calendar

ST = ["state"]
# Thresholds of the contracts.
LOAD_DEGRADED, LOAD_FAILED, WEATHER_DEGRADED_PCT, RAMP_WARN_MW = 0.99, 0.50, 90.0, 1000.0
STATUS = ("ok", "degraded", "failed")


def severity(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == "ok", 0).when(s == "degraded", 1).otherwise(2)


def status_name(level: Column) -> Column:
    return F.when(level == 0, STATUS[0]).when(level == 1, STATUS[1]).otherwise(STATUS[2])


def worst_status(*statuses: Column | str) -> Column:
    cols = [severity(s) for s in statuses]
    return status_name(F.greatest(*cols) if len(cols) > 1 else cols[0])


def load_contract(rows: DataFrame, start: str | None = None, end: str | None = None, states: DataFrame | None = None) -> DataFrame:
    """96-block contract over a date range per state: expected, present, duplicate and non-positive blocks, missing and
    partial dates, share, status and warnings. ``rows`` may hold duplicates; bounds default to the state's own range.
    """
    r = rows.where(F.col("block").between(1, BLOCKS_PER_DAY))
    if start:
        r = r.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        r = r.where(F.col("date") <= F.lit(end).cast("date"))
    cell = r.groupBy("state", "date", "block").agg(F.count(F.lit(1)).alias("_n"), F.avg("load").alias("_v"))
    day = cell.groupBy("state", "date").agg(F.count("_v").alias("present"), F.sum(F.col("_n") - 1).alias("dup"), count_where(F.col("_v") <= 0).alias("nonpos"))
    if states is not None and start and end:
        cal = states.select("state", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    else:
        cal = day_calendar(day, start=start, end=end)
    d = cal.join(day, ["state", "date"], "left").withColumn("present", F.coalesce("present", F.lit(0)))
    s = d.groupBy("state").agg(
        (F.count(F.lit(1)) * BLOCKS_PER_DAY).alias("expected_blocks"), F.sum("present").alias("present_blocks"), F.coalesce(F.sum("dup"), F.lit(0)).alias("duplicate_blocks"),
        F.coalesce(F.sum("nonpos"), F.lit(0)).alias("nonpositive_blocks"), count_where(F.col("present") == 0).alias("missing_dates"),
        count_where(F.col("present").between(1, BLOCKS_PER_DAY - 1)).alias("partial_dates"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("present") == 0, F.col("date").cast("string")))), ",").alias("missing_list"))
    share = F.col("present_blocks") / F.col("expected_blocks")
    level = F.when(share < LOAD_FAILED, 2).when((share < LOAD_DEGRADED) | (F.col("missing_dates") > 0) | (F.col("nonpositive_blocks") > 0), 1).otherwise(0)
    msg = F.concat_ws(" ", *[F.when(F.col(c) > 0, F.format_string(t, F.col(c))) for c, t in (
        ("missing_dates", "%d date(s) have no load data."), ("partial_dates", "%d date(s) are incomplete."),
        ("nonpositive_blocks", "%d load block(s) are non-positive."), ("duplicate_blocks", "%d duplicate load block(s) were averaged."))])
    return s.withColumn("share", share).withColumn("status", status_name(level)).withColumn("warnings", msg)


def weather_contract(weather: DataFrame, expected: DataFrame, start: str, end: str) -> DataFrame:
    """Coverage of temperature cells by the expected districts, districts that never report, status."""
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    w = weather.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("temperature").isNotNull() & F.col("block").between(1, BLOCKS_PER_DAY))
    cells = w.select("state", F.col("location").alias("district"), "date", "block").distinct().groupBy("state", "district").agg(F.count(F.lit(1)).alias("n"))
    names = expected.agg(F.collect_set("location").alias("districts"))  # one row
    e = weather.select("state").distinct().crossJoin(names).select("state", F.explode("districts").alias("district"))
    j = e.join(cells, ["state", "district"], "left")
    s = j.groupBy("state").agg(F.count(F.lit(1)).alias("districts_expected"), F.count("n").alias("districts_seen"), F.sum("n").alias("_n"),
                               F.array_join(F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("district")))), ",").alias("missing_districts"))
    cov = F.coalesce(F.col("_n"), F.lit(0)) / (F.col("districts_expected") * days * BLOCKS_PER_DAY) * 100.0
    s = s.withColumn("coverage_pct", cov)
    bad = (F.col("districts_seen") == 0) | (F.col("coverage_pct") < WEATHER_DEGRADED_PCT)
    return s.withColumn("status", F.when(bad, "degraded").otherwise("ok")).drop("_n")


def quality_report(load: DataFrame, weather: DataFrame) -> DataFrame:
    """Both contracts side by side with the worse status."""
    a = load.select("state", "expected_blocks", "present_blocks", "missing_dates", F.col("status").alias("load_status"))
    b = weather.select("state", "coverage_pct", F.col("status").alias("weather_status"))
    return a.join(b, "state", "left").withColumn("status", worst_status("load_status", F.coalesce("weather_status", F.lit("degraded"))))


def forecast_gate(blocks: DataFrame, ramp_mw: float = RAMP_WARN_MW) -> DataFrame:
    """Per forecast day: 96 blocks, no missing quantile, ordered and non-negative; large ramps only warn."""
    day = Window.partitionBy("state", "date").orderBy("block")
    q = blocks.withColumn("_r", F.abs(F.col("p50") - F.lag("p50").over(day)))
    null = F.col("p10").isNull() | F.col("p50").isNull() | F.col("p90").isNull()
    cross = (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90"))
    neg = (F.col("p10") < 0) | (F.col("p50") < 0) | (F.col("p90") < 0)
    g = q.groupBy("state", "date").agg(F.count(F.lit(1)).alias("blocks"), count_where(null).alias("missing"), count_where(cross).alias("crossings"),
                                       count_where(neg).alias("negatives"), count_where(F.col("_r") > ramp_mw).alias("big_ramps"), F.max("_r").alias("max_ramp"))
    bad = (F.col("blocks") != BLOCKS_PER_DAY) | (F.col("missing") > 0) | (F.col("crossings") > 0) | (F.col("negatives") > 0)
    return g.withColumn("status", F.when(bad, "failed").otherwise("ok"))


def validate_schedule(df: DataFrame, schedule: str = "forecast", baseline: str = "baseline", floor: float = 2500.0, cap: float = 14000.0, max_ramp: float = 400.0,
                      max_gap_pct: float = 5.0, max_dev_pct: float = 15.0, winter: Column | None = None, enforce: bool = True) -> DataFrame:
    """Floor (0.9 of it in winter), ceiling, ramp, deviation and energy-gap checks of a day schedule, limits enforced if asked."""
    low = floor * (F.when(winter, 0.9).otherwise(1.0) if winter is not None else F.lit(1.0))
    x = F.col(schedule)
    adj = F.least(F.greatest(x, low), F.lit(cap)) if enforce else x
    day = Window.partitionBy("state", "date").orderBy("block")
    d = df.withColumn("_low", x < low).withColumn("adjusted", adj)
    d = d.withColumn("_high", F.greatest(x, low) > cap if enforce else x > cap)
    d = d.withColumn("_ramp", F.abs(F.col("adjusted") - F.lag("adjusted").over(day)))
    dev = F.abs(F.col("adjusted") - F.col(baseline)) / F.greatest(F.abs(baseline), F.lit(1.0)) * 100.0
    g = d.groupBy("state", "date").agg(
        count_where(F.col("_low")).alias("floor_breaches"), count_where(F.col("_high")).alias("ceiling_breaches"), count_where(F.col("_ramp") > max_ramp).alias("ramp_breaches"),
        count_where(dev > max_dev_pct).alias("large_deviations"), (F.sum("adjusted") * 0.25).alias("schedule_mwh"), (F.sum(baseline) * 0.25).alias("baseline_mwh"))
    gap = F.abs(F.col("schedule_mwh") - F.col("baseline_mwh")) / F.greatest(F.abs("baseline_mwh"), F.lit(1.0)) * 100.0
    g = g.withColumn("energy_gap_pct", gap)
    flags = F.concat_ws(";", F.when(F.col("floor_breaches") > 0, "FLOOR_BREACH"), F.when(F.col("ceiling_breaches") > 0, "CEILING_BREACH"),
                        F.when(F.col("ramp_breaches") > 0, "RAMP_BREACH"), F.when(F.col("large_deviations") > 0, "LARGE_DEVIATION"),
                        F.when(F.col("energy_gap_pct") > max_gap_pct, "ENERGY_GAP"))
    return g.withColumn("flags", flags).withColumn("status", F.when(flags == "", "ok").otherwise("flagged"))


def forecast_quality(load: DataFrame, weather: DataFrame, gate: DataFrame, coverage: DataFrame, history: DataFrame) -> DataFrame:
    """Quality block of a forecast: worst status, coverages, missing blocks, short-history warning. One row per (state, date)."""
    j = gate.select("state", "date", F.col("status").alias("gate_status")).join(
        load.select("state", F.col("status").alias("load_status"), (F.col("expected_blocks") - F.col("present_blocks")).alias("missing_load_blocks")), "state")
    j = j.join(weather.select("state", "coverage_pct", F.col("status").alias("weather_status")), "state", "left")
    j = j.join(coverage.select("state", "date", "load_share_coverage_pct"), ["state", "date"], "left").join(history.select("state", "history_days"), "state", "left")
    return j.withColumn("status", worst_status("load_status", F.coalesce("weather_status", F.lit("degraded")), "gate_status")).withColumn(
        "short_history", F.col("history_days") < 365)


def range_check(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """Rows outside the plausible range, per state: count, extremes."""
    return df.groupBy("state").agg(count_where(~F.col(value).between(lo, hi)).alias("out_of_range"), F.max(value).alias("max_value"), F.min(value).alias("min_value"),
                                   (ratio(count_where(~F.col(value).between(lo, hi)), F.count(value)) * 100).alias("out_of_range_pct"))
