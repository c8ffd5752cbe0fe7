"""Long-form metric tables: (keys, section, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.numbers import ratio
from quarterhour.functions.stats import avg_where, count_where, rank_corr


def unpivot(df: DataFrame, keys: Sequence[str], section: str | None = None, metrics: Sequence[str] | None = None) -> DataFrame:
    """Every non-key column as one row; values are doubles."""
    names = list(metrics) if metrics is not None else [c for c in df.columns if c not in keys]
    items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    out = df.select(*keys, F.explode(items).alias("m")).select(*keys, "m.*")
    return out.withColumn("section", F.lit(section)) if section else out


def report_summary(df: DataFrame, feature: str = "load", weather: str = "temperature", keys: Sequence[str] = ("state",)) -> DataFrame:
    """Records, level, spread, 7-day trend, weekend effect, weather correlation and the rate of |z| > 3."""
    keys = list(keys)
    x = F.col(feature)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.datediff(F.max("date"), F.min("date")).alias("days"), F.avg(x).alias("average"),
        F.max(x).alias("peak"), F.min(x).alias("minimum"), F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("_sp"),
        avg_where(F.col("is_weekend") == 0, x).alias("weekday_avg"), avg_where(F.col("is_weekend") == 1, x).alias("weekend_avg"))
    daily = df.groupBy(*keys, "date").agg(F.avg(x).alias("v"))
    up, down = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys).orderBy(F.desc("date"))
    trend = (daily.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down)).groupBy(*keys)
             .agg(avg_where(F.col("_u") <= 7, "v").alias("trend_start"), avg_where(F.col("_d") <= 7, "v").alias("trend_end")))
    z = (df.join(base.select(*keys, "average", "_sp"), keys)
         .groupBy(*keys).agg(count_where(F.abs(x - F.col("average")) > 3 * F.col("_sp")).alias("outliers"), F.count(x).alias("_n")))
    rho = rank_corr(df, keys, {"temperature_corr": (feature, weather)}).select(*keys, F.col("rho").alias("temperature_corr"))
    j = base.join(trend, keys).join(z, keys).join(rho, keys, "left")
    return j.select(
        *keys, "records", "days", "average", "peak", "minimum", "std", (ratio("std", "average") * 100).alias("cv_pct"),
        "trend_start", "trend_end", (ratio(F.col("trend_end") - F.col("trend_start"), F.col("trend_start")) * 100).alias("trend_pct"),
        "weekday_avg", "weekend_avg", (ratio(F.col("weekend_avg") - F.col("weekday_avg"), F.col("weekday_avg")) * 100).alias("weekend_effect_pct"),
        F.coalesce("temperature_corr", F.lit(0.0)).alias("temperature_corr"), "outliers",
        (ratio("outliers", "_n") * 100).alias("outlier_rate_pct"))


def data_summary(df: DataFrame, feature: str = "load", keys: Sequence[str] = ("state",)) -> DataFrame:
    """Rows, date span, load level, mean by weekday and by hour: one pass over grouping sets, long form."""
    keys = list(keys)
    d = df.select(*keys, "date", "dow", "hour", feature)
    parts = [
        d.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("total_rows"), F.countDistinct("date").cast("double").alias("total_days"),
                             F.avg(feature).alias("mean_mw"), F.max(feature).alias("peak_mw"), F.min(feature).alias("min_mw")).transform(
            lambda x: unpivot(x, keys, "data_summary")),
    ]
    by = (d.select(*keys, feature, F.explode(F.array(
        F.struct(F.lit("avg_by_dow").alias("section"), F.col("dow").cast("string").alias("metric")),
        F.struct(F.lit("avg_by_hour").alias("section"), F.col("hour").cast("string").alias("metric")))).alias("g"))
        .groupBy(*keys, "g.section", "g.metric").agg(F.avg(feature).alias("value")))
    parts.append(by.select(*keys, "metric", "value", "section"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parse_csv(df: DataFrame, text: str, schema: str) -> DataFrame:
    """CSV lines held in a column -> typed columns (malformed fields become NULL)."""
    return df.select(F.from_csv(text, F.lit(schema)).alias("r")).select("r.*")
