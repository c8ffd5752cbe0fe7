"""Structured Streaming forms of the live tables. Each has a batch twin built from the same window expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarterhour.functions.blocks import block_start
from quarterhour.operators.corrections import intraday_recalibrate
from quarterhour.sources.stage import children, shared_folder

DELAY = "10 minutes"


def as_event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Event time must be a zoned timestamp before a watermark can be set."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def settled_blocks(df: DataFrame, value: str = "value", delay: str = DELAY, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Sum per 15-minute window and key; on a stream a block is emitted once the watermark has passed its end."""
    d = as_event_time(df)
    if d.isStreaming:
        d = d.withWatermark("ts", delay)
    a = d.groupBy(F.window("ts", "15 minutes"), *keys).agg(F.sum(value).alias("load"), F.count(F.lit(1)).alias("n"))
    s = F.col("window.start")
    return a.select(*keys, F.to_date(s).alias("date"), (F.hour(s) * 4 + F.floor(F.minute(s) / 15) + 1).cast("int").alias("block"), "load", "n", F.col("window.end").alias("block_end"))


def without_duplicates(df: DataFrame, key: list[str], delay: str = DELAY) -> DataFrame:
    """Each key once; on a stream the state of a key is kept only as long as the watermark allows repeats."""
    d = as_event_time(df)
    if d.isStreaming:
        return d.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
    return d.dropDuplicates(key)


def trailing_means(df: DataFrame, value: str, length: str = "3 hours", slide: str = "15 minutes", delay: str = DELAY, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Mean of the last hours at every quarter hour, as sliding windows."""
    d = as_event_time(df)
    if d.isStreaming:
        d = d.withWatermark("ts", delay)
    a = d.groupBy(F.window("ts", length, slide), *keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return a.select(*keys, F.col("window.end").alias("at"), "mean", "n")


def episodes(df: DataFrame, gap: str = "30 minutes", delay: str = DELAY, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Flagged rows joined into episodes as long as the next one follows within the gap."""
    d = as_event_time(df)
    if d.isStreaming:
        d = d.withWatermark("ts", delay)
    a = d.groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("blocks"), F.max("ts").alias("last_ts"))
    return a.select(*keys, F.col("session_window.start").alias("start"), "last_ts", "blocks")


# --- two feeds ------------------------------------------------------------------------------------------------------


def two_feeds(dispatch: DataFrame, load: DataFrame, delay: str = "1 day") -> DataFrame:
    """Block rows of two feeds (streams of state, date, block, load) side by side: state, date, block, sldc, aux.

    Each feed keeps its first delivery of a block. A block that both feeds have comes out when the second arrives; one that a
    feed lacks comes out once the watermark, ``delay`` behind the slower feed's newest block, has passed it, and its state
    goes. Blocks that arrive later than that are for the side table (``late_split_each``) and ``reconciled``.
    """
    def side(df: DataFrame, value: str, prefix: str) -> DataFrame:
        rows = df.select(F.col("state").alias(f"{prefix}state"), block_start("date", "block").cast("timestamp").alias(f"{prefix}ts"), F.col("load").alias(value))
        if rows.isStreaming:
            return rows.withWatermark(f"{prefix}ts", delay).dropDuplicatesWithinWatermark([f"{prefix}state", f"{prefix}ts"])
        return rows.dropDuplicates([f"{prefix}state", f"{prefix}ts"])

    a, b = side(dispatch, "sldc", "a_"), side(load, "aux", "b_")
    j = a.join(b, (F.col("a_state") == F.col("b_state")) & (F.col("a_ts") == F.col("b_ts")), "full_outer")
    ts = F.coalesce("a_ts", "b_ts")
    return j.select(F.coalesce("a_state", "b_state").alias("state"), F.to_date(ts).alias("date"), (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15) + 1).cast("int").alias("block"), "sldc", "aux")


def reconciled(joined: DataFrame, late_dispatch: DataFrame, late_load: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two feeds as tables: what the stream put out, and the late rows of blocks that it did not have from that feed."""
    def feed(value: str, late: DataFrame) -> DataFrame:
        keys = ["state", "date", "block"]
        known = joined.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("load"))
        return known.unionByName(late.select(*keys, "load").dropDuplicates(keys).join(known.select(*keys), keys, "left_anti"))
    return feed("sldc", late_dispatch), feed("aux", late_load)


# --- stateful drift monitor -----------------------------------------------------------------------------------------

DRIFT_OUT = "state string, date date, sequence long, settled_blocks int, current_mape double, longest_run int, drift_alert boolean"
DRIFT_STATE = "blocks array<int>, apes array<double>, sequence long"
DAY_MS = 24 * 3600 * 1000


def longest_bad_run(blocks: list[int], apes: list[float | None], limit: float) -> int:
    """Longest run of consecutive settled blocks over the limit; a missing or unusable block ends a run."""
    best = run = 0
    last = None
    for b, a in sorted(zip(blocks, apes)):
        usable = a is not None and a == a
        run = run + 1 if usable and a > limit and (run == 0 or last is None or b == last + 1) else (1 if usable and a > limit else 0)
        best, last = max(best, run), b
    return best


def drift_monitor(rows: DataFrame, forecasts: DataFrame, limit: float = 5.0, run: int = 8, floor: float = 10.0, delay: str = "2 days", hold_days: int = 1) -> DataFrame:
    """Settled blocks (a stream of state, date, block, load) against stored forecasts, with the drift run per (state, date).

    The state of a day holds its blocks seen so far (at most 96), so blocks that arrive out of order are put in their
    place before a run is counted; a block delivered again replaces its earlier value. Every update of a day has the next
    ``sequence``. A day's state goes once the watermark, ``delay`` behind the newest block, is ``hold_days`` past its end;
    rows that come later than the watermark are left to the batch tables.
    """
    timed = rows.select("state", "date", "block", F.col("load").alias("actual"), block_start("date", "block").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    j = timed.join(forecasts.select("state", "date", "block", "forecast"), ["state", "date", "block"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        blocks, apes, sequence = state.get if state.exists else ([], [], 0)
        seen: dict[int, float | None] = dict(zip(blocks, apes))
        for pdf in batches:
            for b, a, f in zip(pdf["block"], pdf["actual"], pdf["forecast"]):
                ok = a is not None and f is not None and a > floor and f > floor
                seen[int(b)] = abs(a - f) / max(a, 1.0) * 100.0 if ok else None
        blocks = sorted(seen)
        apes = [seen[b] for b in blocks]
        state.update((blocks, apes, sequence + 1))
        gone = int(pd.Timestamp(key[1]).timestamp()) * 1000 + (1 + hold_days) * DAY_MS
        state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        good = [a for a in apes if a is not None and a == a]
        longest = longest_bad_run(blocks, apes, limit)
        yield pd.DataFrame([[key[0], key[1], sequence + 1, len(blocks), sum(good) / len(good) if good else None, longest, longest >= run]],
                           columns=["state", "date", "sequence", "settled_blocks", "current_mape", "longest_run", "drift_alert"])

    return j.groupBy("state", "date").applyInPandasWithState(update, DRIFT_OUT, DRIFT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_state(updates: DataFrame) -> DataFrame:
    """The last update of each day, by its sequence, from the append log of ``drift_monitor``."""
    rest = [c for c in updates.columns if c not in ("state", "date", "sequence")]
    return updates.groupBy("state", "date").agg(F.max_by(F.struct(*rest), "sequence").alias("u")).select("state", "date", "u.*")


# --- foreachBatch steps ---------------------------------------------------------------------------------------------


def recalibrate_each(forecasts: DataFrame, settled_path: str, out_path: str, settled: int) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: store the newly settled blocks and rewrite the intraday-corrected forecast of their days.

    Settled blocks are stored by date and epoch, so a batch reads back the dates it touches and no others, however long
    the stream has run. A repeated epoch overwrites its own folders. The output has a folder per epoch.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("state", "date", "block", "load").withColumn("epoch", F.lit(epoch))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "epoch").parquet(settled_path)
        days = batch.select("state", "date").distinct()
        dates = [r["date"] for r in days.select("date").distinct().collect()]  # the calendar of one batch
        if not dates:
            return
        so_far = spark.read.schema(fresh.schema).parquet(settled_path).where(F.col("date").isin(dates) & (F.col("epoch") <= epoch))
        last = so_far.join(days, ["state", "date"], "left_semi").groupBy("state", "date", "block").agg(F.max_by("load", "epoch").alias("actual"))
        f = forecasts.join(days, ["state", "date"], "left_semi").join(last, ["state", "date", "block"], "left")
        intraday_recalibrate(f, settled).select("state", "date", "block", "recalibrated").write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
    return step


def latest_epoch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key from the last epoch that wrote it."""
    last = rows.groupBy(*keys).agg(F.max("epoch").alias("epoch"))
    return rows.join(last, [*keys, "epoch"]).drop("epoch")


def late_split_each(main_path: str, late_path: str, delay_minutes: int = 10) -> Callable[[DataFrame, int], None]:
    """A foreachBatch step: rows older than the newest seen so far minus the delay go to a side table for the batch merge.

    Each epoch writes the newest time of every state seen so far beside the data, so the next one reads one small folder.
    """
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = f"{main_path}-marks"
        before = [n for n in (int(name.partition("=")[2]) for name in children(spark, marks) if name.startswith("epoch=")) if n < epoch]
        known = batch.select("state", F.col("ts").alias("newest")).limit(0)
        if before:
            known = spark.read.schema(known.schema).parquet(f"{marks}/epoch={max(before)}")
        b = batch.join(known.withColumnRenamed("newest", "_seen"), "state", "left")
        late = F.coalesce(F.col("ts") < F.col("_seen") - F.expr(f"INTERVAL {delay_minutes} MINUTES"), F.lit(False))
        b = b.withColumn("_late", late)
        b.where(~F.col("_late")).drop("_late", "_seen").write.mode("overwrite").parquet(f"{main_path}/epoch={epoch}")
        b.where("_late").drop("_late", "_seen").write.mode("overwrite").parquet(f"{late_path}/epoch={epoch}")
        newest = batch.select("state", F.col("ts").alias("newest")).union(known).groupBy("state").agg(F.max("newest").alias("newest"))
        newest.write.mode("overwrite").parquet(f"{marks}/epoch={epoch}")
    return step


def run_steps(stream: DataFrame, spark: SparkSession, step: Callable[[DataFrame, int], None]) -> None:
    """Run a foreachBatch step over what is available."""
    base = f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(step).option("checkpointLocation", base).trigger(availableNow=True).start().awaitTermination()


# --- running a stream to a table ------------------------------------------------------------------------------------


def run_available(stream: DataFrame, spark: SparkSession, base: str | None = None) -> DataFrame:
    """Process what is available and return the appended table, kept in the shared folder.

    With the ``base`` folder of an earlier run the stream goes on where that run ended.
    """
    base = base or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def stage_table(df: DataFrame, spark: SparkSession, files: int = 4) -> str:
    """Write a frame as files in the shared folder, to be read as a stream."""
    path = f"{shared_folder(spark)}/rows-{uuid.uuid4().hex}"
    df.repartition(files).write.parquet(path)
    return path
