"""Feeds with differing column names -> the canonical layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.functions.blocks import block_of, parse_hhmm
from quarterhour.functions.numbers import to_number

# Names under which feeds deliver each quantity, in order of preference.
LOAD_NAMES = ("total_drawal", "load_mw", "drawal_mw", "demand_mw", "mw", "load")
BLOCK_NAMES = ("time_block", "block")
TIME_NAMES = ("datetime", "timestamp", "time", "ts")
DISTRICT_NAMES = ("district", "location", "location_name", "city")
WEATHER_NAMES = {
    "temperature": ("temperature", "temperature_2m", "apparent_temperature"),
    "humidity": ("humidity", "relative_humidity_2m"),
    "precipitation": ("precipitation", "rain"),
    "cloud_cover": ("cloud_cover", "cloudcover"),
    "wind_speed_10m": ("wind_speed_10m", "windspeed_10m"),
    "direct_radiation": ("direct_radiation", "direct_radiation_instant"),
}


def resolve(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """First of the names that the frame has."""
    return next((n for n in names if n in df.columns), None)


def block_column(df: DataFrame) -> Column:
    """Block from a block column, else from a timestamp column."""
    b = resolve(df, BLOCK_NAMES)
    if b:
        return to_number(b).cast("int")
    t = resolve(df, TIME_NAMES)
    return block_of(t) if t else F.lit(None).cast("int")


def load_rows(df: DataFrame, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """(keys, date, block, load, duplicates): blocks outside 1..96 dropped, duplicates averaged and counted."""
    value = resolve(df, LOAD_NAMES)
    rows = df.select(*keys, F.col("date").try_cast("date").alias("date"), block_column(df).alias("block"),
                     (to_number(value) if value else F.lit(None).cast("double")).alias("load"))
    rows = rows.where(F.col("date").isNotNull() & F.col("block").between(1, 96))
    return rows.groupBy(*keys, "date", "block").agg(F.avg("load").alias("load"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def canonical_district(name: Column | str) -> Column:
    """Upper-case district name with separators unified and known aliases replaced."""
    c = F.col(name) if isinstance(name, str) else name
    s = F.trim(F.regexp_replace(F.upper(F.trim(c)), r"[\s_\-]+", " "))
    alias = F.create_map(*[F.lit(x) for kv in dims.DISTRICT_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(alias, s), s)


def weather_rows(df: DataFrame, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Long weather (keys, date, block, district, six variables); absent variables stay NULL."""
    d = resolve(df, DISTRICT_NAMES)
    cols = []
    for out, names in WEATHER_NAMES.items():
        src = resolve(df, names)
        cols.append((to_number(src) if src else F.lit(None).cast("double")).alias(out))
    rows = df.select(*keys, F.col("date").try_cast("date").alias("date"), block_column(df).alias("block"),
                     (canonical_district(d) if d else F.lit("STATE")).alias("district"), *cols)
    return rows.where(F.col("date").isNotNull() & F.col("block").isNotNull())


def raw_demand(df: DataFrame, time: str = "time", value: str = "demand", keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Raw export: strip everything but digits, sign and point, parse HH:MM, average duplicates."""
    num = F.regexp_replace(F.col(value), r"[^0-9.\-]", "").try_cast("double")
    rows = df.select(*keys, "date", parse_hhmm(time).alias("block"), num.alias("load")).where("block is not null and load is not null")
    return rows.groupBy(*keys, "date", "block").agg(F.avg("load").alias("load"))


def one_based_blocks(df: DataFrame, keys: tuple[str, ...] = ("state",), block: str = "block") -> DataFrame:
    """Shift a feed up by one only if its blocks run 0..95 and never reach 96."""
    span = df.groupBy(*keys).agg(F.min(block).alias("_lo"), F.max(block).alias("_hi"))
    zero = (F.col("_lo") == 0) & (F.col("_hi") <= 95)
    return df.join(span, list(keys)).withColumn(block, F.when(zero, F.col(block) + 1).otherwise(F.col(block))).drop("_lo", "_hi")


def rain_total(df: DataFrame) -> DataFrame:
    """Precipitation as rain + showers + snowfall when the feed splits it."""
    parts = [c for c in ("rain", "showers", "snowfall") if c in df.columns]
    if len(parts) < 2:
        return df
    total = sum((F.coalesce(to_number(c), F.lit(0.0)) for c in parts[1:]), F.coalesce(to_number(parts[0]), F.lit(0.0)))
    return df.withColumn("precipitation", total)
