"""2.R streaming: batch twins and streams run to completion over the supplied events."""

import uuid

from pyspark.sql import functions as F

from quarterhour.catalog.c_joins import _MERGED
from quarterhour.catalog.core import query
from quarterhour.functions.blocks import block_start
from quarterhour.operators import merge
from quarterhour.sources.stage import shared_folder
from quarterhour.streaming import live


def event_stream(v):
    """The events as a stream, with the regions they count for."""
    schema = v.table("events").schema
    e = v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(v.dir)
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.explode(F.array(F.lit("ALL"), F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string")))).alias("state"))


_CLOSED = "WHERE CAST(date AS TIMESTAMP) + to_minutes(block * 15) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("r1_settled_blocks", "state date block:i load:f n:i", "SELECT state, date, block, sum(value) AS load, count(*) AS n FROM v_ev GROUP BY ALL")
def _(v):
    return live.settled_blocks(v.ev)


@query("r1_settled_blocks_stream", "state date block:i load:f n:i", f"SELECT * FROM (SELECT state, date, block, sum(value) AS load, count(*) AS n FROM v_ev GROUP BY ALL) {_CLOSED}")
def _(v):
    return live.run_available(live.settled_blocks(event_stream(v)), v.spark)


@query("r2_duplicate_safe_append_stream", "state n:i total:f", "SELECT state, count(*) AS n, sum(value) AS total FROM v_ev GROUP BY state")
def _(v):
    twice = event_stream(v).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = live.run_available(live.without_duplicates(twice, ["event_id", "state"]), v.spark)
    return once.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("r3_live_drift_stream", "state date settled_blocks:i current_mape:f longest_run:i drift_alert", """
    WITH e AS (SELECT *, CASE WHEN actual > 10 AND forecast > 10 THEN abs(actual - forecast) / greatest(actual, 1) * 100 END AS ape FROM v_pair), f AS (SELECT *, coalesce(ape > 5, false) AS bad FROM e),
    g AS (SELECT *, block - row_number() OVER (PARTITION BY state, date, bad ORDER BY block) AS grp FROM f), r AS (SELECT state, date, count(*) AS n FROM g WHERE bad GROUP BY state, date, grp)
    SELECT e.state, e.date, count(*) AS settled_blocks, avg(ape) AS current_mape, coalesce(max(m), 0) AS longest_run, coalesce(max(m), 0) >= 8 AS drift_alert FROM e LEFT JOIN (SELECT state, date, max(n) AS m FROM r GROUP BY ALL) q ON q.state = e.state AND q.date = e.date GROUP BY e.state, e.date""")
def _(v):
    path = live.stage_table(v.load, v.spark, files=3)
    rows = v.spark.readStream.schema(v.load.schema).option("maxFilesPerTrigger", 1).parquet(path)
    updates = live.drift_monitor(rows, v.fc, delay="400 days")  # the files hold days in any order
    return live.latest_state(live.run_available(updates, v.spark))


@query("r4_trailing_means", "state at mean:f n:i", """
    WITH e AS (SELECT state, ts, value FROM v_ev), w AS (SELECT state, value, to_minutes(15) * (1 + k) + time_bucket(INTERVAL 15 MINUTE, ts) AS "at" FROM e CROSS JOIN (SELECT unnest(range(0, 12)) AS k))
    SELECT state, "at", avg(value) AS mean, count(value) AS n FROM w GROUP BY state, "at" """)
def _(v):
    return live.trailing_means(v.ev, "value").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("r5_recalibrated_stream", "state date block:i recalibrated:f", """
    WITH p AS (SELECT f.*, l.load AS actual FROM v_fc f LEFT JOIN v_load l USING (state, date, block) WHERE (state, date) IN (SELECT DISTINCT state, date FROM v_load)),
    e AS (SELECT state, date, avg(actual - forecast) FILTER (WHERE ok) AS bias, count(*) FILTER (WHERE ok) AS n, avg(abs(actual - forecast) / greatest(actual, 1)) FILTER (WHERE ok) * 100 AS mape FROM (SELECT *, block <= 36 AND actual > 10 AND forecast > 10 AS ok FROM p) GROUP BY ALL)
    SELECT p.state, p.date, p.block, CASE WHEN n >= 4 AND mape >= 2 THEN greatest(forecast + CASE WHEN block > 36 THEN bias * (1 - (block - 37) / 59.0::DOUBLE) ELSE 0 END, 0) ELSE forecast END AS recalibrated FROM p JOIN e USING (state, date)""")
def _(v):
    base = live.stage_table(v.load, v.spark, files=3)
    rows = v.spark.readStream.schema(v.load.schema).option("maxFilesPerTrigger", 1).parquet(base)
    live.run_steps(rows, v.spark, live.recalibrate_each(v.fc, f"{base}-settled", f"{base}-out", 36))
    return live.latest_epoch(v.spark.read.parquet(f"{base}-out"), ["state", "date", "block"])


@query("r6_late_split_stream", "state n:i total:f", "SELECT state, count(*) AS n, sum(value) AS total FROM v_ev GROUP BY state")
def _(v):
    base = live.stage_table(v.ev.select("state", F.col("ts").cast("timestamp").alias("ts"), "value"), v.spark, files=3)
    rows = v.spark.readStream.schema("state string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(base)
    live.run_steps(rows, v.spark, live.late_split_each(f"{base}-main", f"{base}-late"))
    both = v.spark.read.parquet(f"{base}-main").unionByName(v.spark.read.parquet(f"{base}-late"))
    return both.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("r6_two_streams", "state date block:i load:f", f"WITH {_MERGED} SELECT * FROM mg")
def _(v):
    """Both feeds as streams of files in order of time, the last one with late and repeated rows; merged by the rule of the batch merge.

    A row of no region, ten days on, lets the watermark pass the blocks that only one feed has.
    """
    early, tables = F.col("date") <= F.lit("2024-01-12").cast("date"), {}
    for name, feed in (("dispatch", v.sldc), ("load", v.load)):
        path = f"{shared_folder(v.spark)}/feed-{uuid.uuid4().hex}"
        late = (F.col("state") == "R1") & (F.col("date") <= F.lit("2024-01-05").cast("date"))
        clock = feed.groupBy().agg(F.date_add(F.max("date"), 10).alias("date")).select(F.lit("~").alias("state"), "date", F.lit(1).alias("block"), F.lit(0.0).alias("load"))
        for part in (feed.where(early & ~late), feed.where(~early), feed.where(late | (F.col("date") == F.lit("2024-01-29").cast("date"))).unionByName(clock)):
            part.coalesce(1).write.mode("append").parquet(path)
        tables[name] = path
    streams = {n: v.spark.readStream.schema("state string, date date, block int, load double").option("maxFilesPerTrigger", 1).parquet(p) for n, p in tables.items()}
    joined = live.run_available(live.two_feeds(streams["dispatch"], streams["load"], "3 days"), v.spark).where("state <> '~'")
    late_rows = {}
    for name, stream in streams.items():
        # Lateness is that of the whole feed, as the stream's watermark is.
        timed = stream.where("state <> '~'").select(F.struct("*").alias("row"), F.lit("all").alias("state"), block_start("date", "block").cast("timestamp").alias("ts"))
        live.run_steps(timed, v.spark, live.late_split_each(f"{tables[name]}-main", f"{tables[name]}-late", 3 * 24 * 60))
        late_rows[name] = v.spark.read.parquet(f"{tables[name]}-late").select("row.*")
    dispatch, load = live.reconciled(joined, late_rows["dispatch"], late_rows["load"])
    return merge.priority_merge(dispatch, load)


@query("r7_episodes", "state start last_ts blocks:i", """
    WITH f AS (SELECT state, CAST(date AS TIMESTAMP) + to_minutes((block - 1) * 15) AS ts FROM v_load WHERE load > 150),
    g AS (SELECT *, sum(CASE WHEN ts - p <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY state ORDER BY ts) AS run FROM (SELECT *, lag(ts) OVER (PARTITION BY state ORDER BY ts) AS p FROM f))
    SELECT state, min(ts) AS start, max(ts) AS last_ts, count(*) AS blocks FROM g GROUP BY state, run""")
def _(v):
    flagged = v.load.where("load > 150").withColumn("ts", block_start("date", "block"))
    e = live.episodes(flagged)
    return e.withColumns({"start": F.col("start").cast("timestamp_ntz"), "last_ts": F.col("last_ts").cast("timestamp_ntz")})
