"""Writers: plain files, create-only records, duplicate-free appends, versioned stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import block_label
from quarterhour.sources.stage import children


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_by_month(df: DataFrame, path: str, mode: str = "error") -> None:
    """Layout for the large stored tables: state and month folders, so date filters prune files.

    Rows are spread over a few files per month by day of month, which keeps a hot state from one writer.
    """
    out = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    out.repartition("state", "month", F.pmod(F.dayofmonth("date"), F.lit(8))).write.mode(mode).partitionBy("state", "month").parquet(path)


def not_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; the first of several new rows with one key wins."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def top_up(new: DataFrame, stored: DataFrame, keys: list[str], group: tuple[str, ...] = ("state",), date: str = "date") -> DataFrame:
    """Incremental append: rows from each group's latest stored date onwards, without stored keys.

    A group that is not stored yet comes whole. Only the tail of the stored table from that date takes part in the anti-join.
    """
    last = stored.groupBy(*group).agg(F.max(date).alias("_last"))
    fresh = new.join(last, list(group), "left").where(F.col("_last").isNull() | (F.col(date) >= F.col("_last")))
    tail = stored.join(last, list(group)).where(F.col(date) >= F.col("_last")).select(*keys)
    return fresh.drop("_last").dropDuplicates(keys).join(tail, keys, "left_anti")


def record_id(*parts: Column | str) -> Column:
    """Short content digest that names an immutable record."""
    cols = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 12)


def append_new_records(df: DataFrame, path: str, id_col: str = "record_id") -> None:
    """Create-only append: ids already stored at ``path`` are left out, and an id that comes twice is stored once."""
    spark = df.sparkSession
    out = df.dropDuplicates([id_col])
    if any(not name.startswith(("_", ".")) for name in children(spark, path)):
        out = out.join(spark.read.parquet(path).select(id_col), id_col, "left_anti")
    out.write.mode("append").parquet(path)


def with_revision(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Revision number of each stored version, starting at 0."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("revision", F.row_number().over(w) - 1)


def schedule_export(df: DataFrame, schedule: str, baseline: str) -> DataFrame:
    """Block, Time, Schedule_MW, Baseline_MW with the day's energy and peak beside each row."""
    w = Window.partitionBy("state", "date")
    return df.select("state", "date", F.col("block").alias("Block"), block_label("block").alias("Time"),
                     F.col(schedule).alias("Schedule_MW"), F.col(baseline).alias("Baseline_MW"),
                     (F.sum(schedule).over(w) * 0.25).alias("energy_mwh"), F.max(schedule).over(w).alias("peak_mw"))
