import datetime

from helpers import as_dict, day, series
from pyspark.sql import functions as F

from quarterhour.operators import merge
from quarterhour.operators.accuracy import live_accuracy
from quarterhour.sources import readers, sinks
from quarterhour.sources.stage import shared
from quarterhour.streaming import live


def test_partitioned_write_prunes(spark, tmp_path):
    df = series(spark, 40).unionByName(series(spark, 40, state="B"))
    sinks.write_by_month(df, f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t").where("state = 'A' and month = '2024-02'")
    assert back.count() == 9 * 96
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()


def test_record_append_is_create_only(spark, tmp_path):
    p = f"{tmp_path}/r"
    df = series(spark, 2, blocks=[1]).withColumn("record_id", sinks.record_id("state", "date"))
    sinks.append_new_records(df, p)
    sinks.append_new_records(df.withColumn("load", F.lit(-1.0)), p)
    out = spark.read.parquet(p)
    assert out.count() == 2 and out.where("load = -1").count() == 0


def test_csv_round_trip_and_table_scan(spark, tmp_path):
    df = series(spark, 3).select("state", "date", F.col("block").alias("time_block"), F.col("load").alias("total_drawal"))
    sinks.write_csv(df, f"{tmp_path}/c")
    csv = readers.read_frame_csv(spark, f"{tmp_path}/c", "state STRING, date DATE, time_block INT, total_drawal DOUBLE")
    assert csv.count() == 288 and csv.where("time_block = 5").first()["Datetime"].minute == 0
    df.write.parquet(f"{tmp_path}/db/load")
    got = readers.read_table(spark, f"{tmp_path}/db", "load", state="a", date="2024-01-02")
    assert got.count() == 96
    assert "PushedFilters" in got._jdf.queryExecution().toString()


def test_top_up_ignores_conflicts(spark):
    old = series(spark, 3, lambda d, b: 1)
    new = series(spark, 5, lambda d, b: 2)
    add = sinks.top_up(new, old, ["state", "date", "block"])
    assert add.count() == 2 * 96 and add.agg(F.min("date")).first()[0] == day(3)


def test_new_states_are_kept(spark):
    old, new = series(spark, 3), series(spark, 5).union(series(spark, 2, state="B"))
    add = sinks.top_up(new, old, ["state", "date", "block"])
    assert add.where("state = 'B'").count() == 192 and add.count() == 384
    assert sinks.top_up(new, old.limit(0), ["state", "date", "block"]).count() == 7 * 96
    assert merge.fill_from(old, new).where("state = 'B'").count() == 192


def test_shared_stage_keeps_rows(spark):
    assert shared(series(spark, 2)).count() == 192


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp, value double, state string")


def test_stream_equals_batch_with_shuffled_and_duplicate_files(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(minutes=(i * 7) % 600), float(i), "A") for i in range(200)]
    for k in range(4):
        _events(spark, rows[k::4] + rows[k * 3: k * 3 + 2]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(_events(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = live.run_available(live.without_duplicates(s, ["event_id"], "1 day"), spark)
    assert out.count() == 200
    blocks = live.run_available(live.settled_blocks(s.where("event_id >= 0"), delay="1 day"), spark)
    assert blocks.count() == 0  # nothing is final while the watermark waits a day


def test_late_rows_go_to_the_side_table(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1, 12)
    step = live.late_split_each(f"{tmp_path}/main", f"{tmp_path}/late", 10)
    step(_events(spark, [(1, t0, 1.0, "A")]), 0)
    step(_events(spark, [(2, t0 - datetime.timedelta(minutes=5), 1.0, "A"), (3, t0 - datetime.timedelta(minutes=30), 1.0, "A"), (4, t0 - datetime.timedelta(days=1), 1.0, "B")]), 1)
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/late").collect()} == {3}
    assert {r.event_id for r in spark.read.parquet(f"{tmp_path}/main").collect()} == {1, 2, 4}


def test_drift_run_is_sequenced_before_counting(spark, tmp_path):
    assert live.longest_bad_run([3, 1, 2], [9.0, 9.0, 9.0], 5.0) == 3
    assert live.longest_bad_run([1, 2, 4], [9.0, 9.0, 9.0], 5.0) == 2
    assert live.longest_bad_run([1, 2, 3], [9.0, None, 9.0], 5.0) == 1
    load = series(spark, 1, lambda d, b: 100.0 if b < 20 or b > 30 else 200.0)
    fc = series(spark, 1, lambda d, b: 100.0).withColumnRenamed("load", "forecast")
    for odd in (1, 0):
        load.where(F.col("block") % 2 == odd).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    s = spark.readStream.schema(load.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/d")
    r = live.latest_state(live.run_available(live.drift_monitor(s, fc), spark)).first()
    assert r["settled_blocks"] == 96 and r["longest_run"] == 11 and r["drift_alert"]


def test_redelivered_block_replaces_its_update(spark, tmp_path):
    load = series(spark, 1, lambda d, b: 109.0 if b == 1 else 104.0, blocks=range(1, 3))
    fc = series(spark, 1, lambda d, b: 100.0, blocks=range(1, 3)).withColumnRenamed("load", "forecast")
    load.coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    load.where("block = 1").withColumn("load", F.lit(100.0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
    s = spark.readStream.schema(load.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/d")
    updates = live.run_available(live.drift_monitor(s, fc), spark)
    r = live.latest_state(updates).first()
    assert r["settled_blocks"] == 2 and r["current_mape"] < 2.0 and updates.agg(F.max("sequence")).first()[0] == 2


def test_stored_ids_are_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "record_id string, x int")
    for _ in range(2):
        sinks.append_new_records(rows, f"{tmp_path}/records")
    assert sorted(r.record_id for r in spark.read.parquet(f"{tmp_path}/records").collect()) == ["a", "b"]


def test_batch_and_stream_count_runs_alike(spark):
    rows = [("A", day(0), b, 100.0, 120.0 if b <= 5 or 20 <= b <= 25 else 100.0) for b in [*range(1, 6), *range(20, 26)]]
    got = live_accuracy(spark.createDataFrame(rows, "state string, date date, block int, forecast double, actual double")).first()
    assert got["longest_run"] == 6 == live.longest_bad_run([r[2] for r in rows], [20.0] * len(rows), 5.0) and not got["drift_alert"]


def test_recalibration_per_batch(spark, tmp_path):
    fc = series(spark, 1, lambda d, b: 100.0).withColumnRenamed("load", "forecast")
    step = live.recalibrate_each(fc, f"{tmp_path}/s", f"{tmp_path}/o", 12)
    act = series(spark, 1, lambda d, b: 120.0, blocks=range(1, 13))
    step(act.where("block <= 6"), 0)
    step(act.where("block > 6"), 1)
    got = as_dict(spark.read.parquet(f"{tmp_path}/o").where("epoch = 1"), ["block"], "recalibrated")
    assert got[13] == 120.0 and abs(got[96] - 100.0) < 1e-9 and got[5] == 100.0


def _feeds(spark, tmp_path, name, *parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_two_feeds_match_redeliver_and_restart(spark, tmp_path):
    a, b = series(spark, 3, lambda d, b: 10.0 * d + b, blocks=range(1, 97, 8)), series(spark, 3, lambda d, b: 1000.0 + b, blocks=range(1, 97, 12))
    clock = lambda d: series(spark, 1, blocks=[1], state="~").withColumn("date", F.lit(day(d)))
    first = a.where(F.col("date") <= F.lit(day(1)))
    base = f"{tmp_path}/run"
    s = _feeds(spark, tmp_path, "a", first)
    t = _feeds(spark, tmp_path, "b", b.where(F.col("date") <= F.lit(day(1))))
    one = live.run_available(live.two_feeds(s, t, "1 day"), spark, base).where("state <> '~'")
    assert one.where("sldc is not null and aux is not null").count() == 2 * 4  # blocks 1, 25, 49, 73 on two days
    # The rest, with all of the first part delivered again, and a clock far ahead.
    s = _feeds(spark, tmp_path, "a", first.withColumn("load", F.lit(-1.0)), a.where(F.col("date") > F.lit(day(1))), clock(20))
    t = _feeds(spark, tmp_path, "b", b.where(F.col("date") > F.lit(day(1))), clock(20))
    out = live.run_available(live.two_feeds(s, t, "1 day"), spark, base).where("state <> '~'")
    batch = live.two_feeds(a, b)
    pick = lambda df: sorted((tuple(r) for r in df.select("state", "date", "block", "sldc", "aux").collect()), key=repr)
    assert pick(out) == pick(batch) and out.where("sldc is null or aux is null").count() == 3 * (12 + 8 - 2 * 4)


def test_late_rows_of_a_feed_are_taken_from_the_side_table(spark):
    joined = spark.createDataFrame([("A", day(0), 1, 5.0, None), ("A", day(0), 2, None, 7.0)], "state string, date date, block int, sldc double, aux double")
    late = series(spark, 1, lambda d, b: 100.0 + b, blocks=[1, 2])
    dispatch, load = live.reconciled(joined, late, late.where("block = 1"))
    assert as_dict(dispatch, ["block"], "load") == {1: 5.0, 2: 102.0} and as_dict(load, ["block"], "load") == {1: 101.0, 2: 7.0}
