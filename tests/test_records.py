"""The record store: every id once, and appends that read only folders which may hold their ids."""

from pyspark.sql import functions as F

from quarterhour.sources.records import RecordStore


def some(spark, lo, hi, tag="a"):
    return spark.range(lo, hi).select(F.sha2(F.col("id").cast("string"), 256).alias("record_id"), F.col("id").alias("n"), F.lit(tag).alias("tag"))


def test_appends_are_exact_and_pruned(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"))
    first = store.append(some(spark, 0, 3000).union(some(spark, 0, 100, "twice")))
    assert (first.batch, first.stored, first.read) == (1, 3000, ())
    fresh = store.append(some(spark, 3000, 5000))
    assert fresh.stored == 2000 and len(fresh.read) <= 3  # of up to 256 folders: nearly no id passes the filters by chance
    few = store.append(some(spark, 2995, 2998, "b").union(some(spark, 5000, 5001, "b")))
    assert few.stored == 1 and 1 <= len(few.read) <= 4 and {b for b, _ in few.read} >= {1}
    again = store.append(some(spark, 0, 5001, "c"))
    assert (again.batch, again.stored) == (None, 0) and {b for b, _ in again.read} == {1, 2, 3}
    rows = store.read()
    assert rows.count() == rows.select("record_id").distinct().count() == 5001
    assert rows.where("n < 3000 and tag not in ('a', 'twice')").count() == 0 and rows.columns == ["record_id", "n", "tag"]


def test_filters_never_miss_a_stored_id(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"), "n")
    rows = some(spark, 0, 2000).withColumn("n", F.when(F.col("n") % 7 == 0, None).otherwise(F.col("n")))
    assert store.append(rows).stored == 2000 - len(range(0, 2000, 7))
    ids = store.read().select(F.col("n").cast("string").alias("id"))
    from quarterhour.sources.records import prefix_of
    assert store.maybe_stored(ids.withColumn("prefix", prefix_of(F.col("id"))), store.batches()).count() == ids.count()


def test_what_a_failed_append_left_is_not_read(spark, tmp_path):
    store = RecordStore(spark, str(tmp_path / "store"))
    store.append(some(spark, 0, 50))
    some(spark, 50, 60).withColumn("prefix", F.lit(3)).write.partitionBy("prefix").parquet(str(tmp_path / "store" / "records" / "batch=2"))
    assert store.read().count() == 50
    done = store.append(some(spark, 40, 70))
    assert (done.batch, done.stored) == (3, 20) and store.read().count() == 70
    assert store.append(some(spark, 0, 0)).stored == 0
