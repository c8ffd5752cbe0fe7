"""Joins and merges of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.operators.grid import day_lag

KEY = ["state", "date", "block"]


def priority_merge(sldc: DataFrame, load: DataFrame) -> DataFrame:
    """Per day: up to the last valid block of the priority feed use it (else the other); afterwards the reverse."""
    a = sldc.select(*KEY, F.col("load").alias("sldc"))
    b = load.select(*KEY, F.col("load").alias("aux"))
    m = a.join(b, KEY, "full_outer")
    last = F.max(F.when(F.col("sldc").isNotNull(), F.col("block"))).over(Window.partitionBy("state", "date"))
    in_zone = F.col("block") <= F.coalesce(last, F.lit(0))
    m = m.withColumn("in_zone", in_zone)
    value = F.when(F.col("in_zone"), F.coalesce("sldc", "aux")).otherwise(F.coalesce("aux", "sldc"))
    source = F.when(F.col("in_zone") & F.col("sldc").isNotNull() | F.col("aux").isNull(), "sldc").otherwise("aux")
    return m.select(*KEY, value.alias("load"), source.alias("source"))


def with_weather(load: DataFrame, weather: DataFrame, how: str = "left") -> DataFrame:
    return load.join(weather, KEY, how)


def only_dates(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows on the given (state,) dates."""
    keys = [k for k in ("state", "date") if k in dates.columns]
    return df.join(dates, keys, "left_semi")


def history_before_forecast(df: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """Drop FORECAST rows wherever the key also has HISTORICAL rows."""
    has = F.max(F.when(F.col(kind) == "HISTORICAL", 1).otherwise(0)).over(Window.partitionBy(*keys))
    return df.withColumn("_h", has).where((F.col(kind) != "FORECAST") | (F.col("_h") == 0)).drop("_h")


def keep_preferred(df: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """One row per key; HISTORICAL (later in the alphabet) beats FORECAST. Done as a map-side max, not a sort."""
    rest = [c for c in df.columns if c not in keys and c != kind]
    best = F.max(F.struct(kind, *rest)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, "b.*")


def fill_from(primary: DataFrame, second: DataFrame, value: str = "load") -> DataFrame:
    """Zeros and gaps of the first feed take the second; dates newer than the first feed's last are appended.

    A state that only the second feed has is appended whole.
    """
    b = second.select(*KEY, F.col(value).alias("_b"))
    last = primary.groupBy("state").agg(F.max("date").alias("_last"))
    a = primary.select(*KEY, F.col(value).alias("_a"), F.lit(1).alias("_in"))
    m = a.join(b, KEY, "full_outer").join(last, "state", "left")
    keep = F.col("_in").isNotNull() | F.col("_last").isNull() | (F.col("date") > F.col("_last"))
    return m.where(keep).select(*KEY, F.when(F.coalesce("_a", F.lit(0.0)) == 0, F.coalesce("_b", "_a")).otherwise(F.col("_a")).alias(value))


def append_unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def with_day_lags(df: DataFrame, lags: tuple[int, ...], value: str = "load", prefix: str = "lag_") -> DataFrame:
    """Same block k days before, for several k, in one shuffle on (state, block)."""
    return df.select(*df.columns, *[day_lag(value, k).alias(f"{prefix}{k}d") for k in lags])


def benchmarks(grid: DataFrame, lags: tuple[int, ...] = (1, 7, 365), floor: float = 1.0) -> DataFrame:
    """Today and the lagged days on one row per block; readings at or below ``floor`` are missing."""
    clean = grid.withColumn("load", F.when(F.col("load") > floor, F.col("load")))
    return with_day_lags(clean, lags, "load", "t_minus_").withColumnRenamed("load", "today")


def segment_join(df: DataFrame, segments: DataFrame, block: str = "block") -> DataFrame:
    """Attach the segment whose [start, end] holds the block; one that wraps midnight has its start after its end.

    Segments are laid out block by block (96 each at most), so the join is on equal blocks.
    """
    start, end = F.col("seg_start").cast("int"), F.col("seg_end").cast("int")
    held = F.when(start <= end, F.sequence(start, F.greatest(start, end))).otherwise(F.concat(F.sequence(start, F.greatest(start, F.lit(96))), F.sequence(F.lit(1), F.greatest(end, F.lit(1)))))
    s = segments.withColumn("_held", F.explode(held))
    return df.join(s, F.col(block) == F.col("_held")).drop("_held")


def pivot_dates(df: DataFrame, dates: list[str], value: str = "load") -> DataFrame:
    """One column per given date, one row per (state, block)."""
    cols: list[Column] = [F.max(F.when(F.col("date") == F.lit(d).cast("date"), F.col(value))).alias("d_" + d.replace("-", "_")) for d in dates]
    return df.where(F.col("date").isin(*[F.lit(d).cast("date") for d in dates])).groupBy("state", "block").agg(*cols)


def map_districts(df: DataFrame, weights: DataFrame, name: str = "location") -> DataFrame:
    """Canonical district, circle and load share (0 for unknown places). The weight table has a few dozen rows."""
    from quarterhour.sources.normalise import canonical_district
    out = df.withColumn("district", canonical_district(name)).join(weights, "district", "left")
    return out.withColumn("share_pct", F.coalesce("share_pct", F.lit(0.0)))
