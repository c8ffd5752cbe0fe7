"""Filtered reads of the stored tables, and file readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterhour.functions.blocks import block_start, state_slug
from quarterhour.schema import TABLES


def slug(state: str) -> str:
    return state.strip().upper().replace(" ", "_").replace("-", "_")


def scan(df: DataFrame, table: str, state: str, date: str | None = None, from_date: str | None = None,
         to_date: str | None = None, location: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a stored table for one state, by date or date range, ordered by date and block.

    The predicates are plain column comparisons, so they reach the Parquet scan or the JDBC source.
    """
    if table not in TABLES:
        raise KeyError(f"unknown table {table!r}")
    _, block_col, values = TABLES[table]
    out = df.where(F.col("state") == slug(state))
    if date is not None:
        out = out.where(F.col("date") == F.lit(date).cast("date"))
    else:
        if from_date:
            out = out.where(F.col("date") >= F.lit(from_date).cast("date"))
        if to_date:
            out = out.where(F.col("date") <= F.lit(to_date).cast("date"))
    keys = ["date", block_col]
    if table == "weather_loc":
        keys.append("location")
        if location:
            out = out.where(F.col("location") == location.strip().upper())
    present = [v for v in values if v in out.columns]
    out = out.select("state", *keys, *present).orderBy(*keys)
    return out if limit is None else out.limit(limit)


def read_table(spark: SparkSession, root: str, table: str, **filters) -> DataFrame:
    """``scan`` over ``root/table`` in Parquet, with the declared schema (no inference)."""
    schema = TABLES[table][0]
    return scan(spark.read.schema(schema).parquet(f"{root}/{table}"), table, **filters)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
              months: list[tuple[str, str]] | None = None, **filters) -> DataFrame:
    """``scan`` over a JDBC table; one partition per (from, to) date pair when ``months`` is given."""
    props = properties or {}
    if months:
        preds = [f"date >= DATE '{a}' AND date < DATE '{b}'" for a, b in months]
        df = spark.read.jdbc(url, table, predicates=preds, properties=props)
    else:
        df = spark.read.jdbc(url, table, properties=props)
    return scan(df, table, **filters)


def load_frame(df: DataFrame, state: str, from_date=None, to_date=None) -> DataFrame:
    return scan(df, "load", state, from_date=from_date, to_date=to_date)


def weather_loc_frame(df: DataFrame, state: str, from_date=None, to_date=None, location=None) -> DataFrame:
    return scan(df, "weather_loc", state, from_date=from_date, to_date=to_date, location=location)


def weather_mean_frame(df: DataFrame, state: str, from_date=None, to_date=None) -> DataFrame:
    return scan(df, "weather_mean", state, from_date=from_date, to_date=to_date)


def forecast_frame(df: DataFrame, state: str, from_date=None, to_date=None) -> DataFrame:
    """Stored forecast with its block column normalised to ``time_block``."""
    out = scan(df, "forecast", state, from_date=from_date, to_date=to_date)
    return out.withColumnRenamed("block", "time_block")


def states(df: DataFrame) -> DataFrame:
    return df.select("state").distinct().orderBy("state")


def locations(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.col("state") == slug(state)).select("location").distinct().orderBy("location")


def coverage(df: DataFrame) -> DataFrame:
    """First and last date, number of dates and of rows per state."""
    per_day = df.groupBy("state", "date").agg(F.count(F.lit(1)).alias("_n"))
    return per_day.groupBy("state").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                        F.count(F.lit(1)).alias("dates"), F.sum("_n").alias("rows"))


def load_dates(df: DataFrame, state: str) -> DataFrame:
    return df.where(F.col("state") == slug(state)).select("date").distinct().orderBy("date")


def latest_days(df: DataFrame, days: int) -> DataFrame:
    """Rows of the last N calendar days, counted back from each state's own latest date."""
    last = df.groupBy("state").agg(F.max("date").alias("_last"))
    return df.join(last, "state").where(F.col("date") > F.date_sub("_last", days)).drop("_last")


def reshape(df: DataFrame, value: str, out: str, block: str = "block") -> DataFrame:
    return df.select("state", "date", F.col(block).alias("time_block"), F.col(value).alias(out))


def month_year_extract(df: DataFrame, months: tuple[int, ...], years: tuple[int, int], date: str = "date") -> DataFrame:
    return df.where(F.month(date).isin(*months) & F.year(date).between(*years))


def read_frame_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema; a missing Datetime is derived from date and time_block."""
    df = spark.read.csv(path, header=True, schema=schema)
    if "Datetime" not in df.columns:
        df = df.withColumn("Datetime", block_start("date", "time_block"))
    return df


def slug_columns(df: DataFrame, c: str = "state") -> DataFrame:
    return df.withColumn(c, state_slug(c))
