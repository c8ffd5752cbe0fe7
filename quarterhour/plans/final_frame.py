"""The wide modelling frame: merged load, weather, calendar and simple features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterhour.functions.blocks import block_start, cyclic, weekday
from quarterhour.operators.calendar import holiday_flag
from quarterhour.operators.merge import priority_merge, with_weather

# The column order of the wide frame.
FINAL_COLUMNS = [
    "date", "time_block", "total_drawal", "Datetime", "temperature", "humidity", "precipitation", "cloud_cover", "cloud_cover_low",
    "sunshine_duration", "direct_radiation", "wind_speed_10m", "hour", "minute", "day_of_week", "day_of_month", "month", "is_weekend",
    "is_holiday", "hour_cos", "dow_sin", "dow_cos", "block_sin", "block_cos", "is_peak_hour", "is_night", "is_business_hour",
    "temp_squared", "temp_cubed", "temperature_sin",
]


def final_features(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Calendar flags, cyclic encodings, period flags and temperature powers. Needs date, block, load, temperature."""
    df = holiday_flag(df, holidays).withColumn("Datetime", block_start("date", "block"))
    h, dow = F.hour("Datetime"), weekday("date")
    ds, dc = cyclic(dow, 7.0)
    bs, bc = cyclic(F.col("block"), 96.0)
    weekend = (dow >= 5).cast("int")
    t = F.col("temperature")
    return df.withColumns({
        "hour": h, "minute": F.minute("Datetime"), "day_of_week": dow, "day_of_month": F.dayofmonth("Datetime"), "month": F.month("Datetime"),
        "is_weekend": weekend, "hour_cos": cyclic(h, 24.0)[1], "dow_sin": ds, "dow_cos": dc, "block_sin": bs, "block_cos": bc,
        "is_peak_hour": (((h >= 6) & (h < 10)) | ((h >= 18) & (h < 22))).cast("int"), "is_night": ((h >= 22) | (h < 6)).cast("int"),
        "is_business_hour": ((h >= 9) & (h < 18) & (weekend == 0)).cast("int"),
        "temp_squared": t * t, "temp_cubed": t * t * t, "temperature_sin": F.sin(t * (2.0 * math.pi) / 40.0),
    })


def final_frame(sldc: DataFrame, load: DataFrame, weather: DataFrame, holidays: DataFrame,
                from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    """Merged feeds with weather and features in the fixed column order; date filters reach both feeds' scans."""
    def cut(df: DataFrame) -> DataFrame:
        if from_date:
            df = df.where(F.col("date") >= F.lit(from_date).cast("date"))
        return df.where(F.col("date") <= F.lit(to_date).cast("date")) if to_date else df

    m = with_weather(priority_merge(cut(sldc), cut(load)).drop("source"), cut(weather))
    out = final_features(m, holidays)
    for c in FINAL_COLUMNS:
        if c not in out.columns and c not in ("time_block", "total_drawal"):
            out = out.withColumn(c, F.lit(None).cast("double"))
    out = out.withColumnRenamed("block", "time_block").withColumnRenamed("load", "total_drawal")
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd")).select("state", *FINAL_COLUMNS)
