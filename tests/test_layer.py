"""The stored layer: upkeep by partitions, files counted once, reads with a time to live."""

import os

import pytest
from pyspark.sql import functions as F

from quarterhour.catalog import views
from quarterhour.sources.layer import Layer, month_of, source_files

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark, rows):
    import datetime
    return spark.createDataFrame([(i, datetime.datetime.fromisoformat(ts), u, kind, v, f'{{"k": {k}}}') for i, ts, u, kind, v, k in rows], EVENTS)


def some(spark, lo, hi):
    return events(spark, [(i, f"2024-{1 + i % 3:02d}-{1 + i % 27:02d} {i % 24:02d}:{i % 60:02d}:00", i % 11, ["click", "error", "view"][i % 3], i % 50 + 0.25, i % 100) for i in range(lo, hi)])


@pytest.fixture()
def layer(spark, tmp_path):
    return Layer(spark, str(tmp_path / "layer"), views.LAYER_KEYS, views.LAYER_SUMS, ("value_max",), {"blocks": views.block_rows})


def rows(df):
    return sorted((tuple(r) for r in df.select("state", "date", "block", "load", "feed_load", "temperature", "precipitation").collect()), key=repr)


def direct(layer, df):
    return rows(views.block_rows(layer.aggregated(views.layer_rows(df))))


def test_late_rows_change_their_partition_only(spark, layer, tmp_path):
    source = str(tmp_path / "events")
    some(spark, 0, 400).coalesce(2).write.parquet(source)
    first = layer.refresh(source, views.layer_rows)
    assert first.version == 1 and rows(layer.read("blocks")) == direct(layer, some(spark, 0, 400))
    assert layer.refresh(source, views.layer_rows) == first  # no new file, nothing written
    late = events(spark, [(900, "2024-02-03 10:05:00", 4, "view", 77.0, 5), (901, "2024-02-28 10:05:00", 4, "view", 7.0, 5)])
    late.write.mode("append").parquet(source)
    second = layer.refresh(source, views.layer_rows)
    changed = {p for p, v in second.parts.items() if first.parts.get(p) != v}
    assert changed == {("ALL", "2024-02"), ("R1", "2024-02")} and second.version == 2
    assert rows(layer.read("blocks")) == direct(layer, spark.read.parquet(source))
    old = {f for f in source_files(spark, f"{layer.path}/blocks/version=1")}
    read = layer.read("blocks").select("state", month_of().alias("month"), F.input_file_name().alias("f")).distinct().collect()
    assert all(("version=2" in r.f) == ((r.state, r.month) in changed) for r in read) and old


def test_a_changed_source_file_builds_anew(spark, layer, tmp_path):
    source = str(tmp_path / "events")
    some(spark, 0, 100).coalesce(1).write.parquet(source)
    layer.refresh(source, views.layer_rows)
    name = next(f for f in os.listdir(source) if f.endswith(".parquet"))
    some(spark, 50, 300).coalesce(1).write.parquet(str(tmp_path / "other"))
    other = next(f for f in os.listdir(tmp_path / "other") if f.endswith(".parquet"))
    os.replace(tmp_path / "other" / other, os.path.join(source, name.replace("part-", "part-9")))
    os.unlink(os.path.join(source, name))
    layer.refresh(source, views.layer_rows)
    assert rows(layer.read("blocks")) == direct(layer, some(spark, 50, 300))


def test_reads_choose_partitions_and_dates(spark, layer):
    layer.replace(views.layer_rows(some(spark, 0, 500)))
    part = layer.read("blocks", start="2024-02-10", end="2024-03-05")
    assert rows(part) == [r for r in direct(layer, some(spark, 0, 500)) if "2024-02-10" <= str(r[1]) <= "2024-03-05"]
    scanned = {r.f.split("month=")[1][:7] for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
    assert scanned == {"2024-02", "2024-03"}
    assert layer.read("blocks", parts={("R1", "2024-01")}).select("state").distinct().collect() == [("R1",)]
    assert layer.read("blocks", parts={("none", "2024-01")}).count() == 0


def test_time_to_live(spark, layer):
    before, after = some(spark, 0, 200), some(spark, 0, 260)
    asked = []

    def fetch(parts):
        asked.append(set(parts))
        return views.layer_rows(after).where(F.concat_ws("/", "state", month_of()).isin([f"{s}/{m}" for s, m in parts]))

    layer.replace(views.layer_rows(before), written_at=100.0)
    layer.replace(views.layer_rows(before).where("state = 'R0'"), written_at=700.0)
    fresh = rows(layer.read_fresh("blocks", 500.0, fetch, now=800.0))
    want = [r for r in direct(layer, after) if r[0] != "R0"] + [r for r in direct(layer, before) if r[0] == "R0"]
    assert fresh == sorted(want, key=repr) and len(asked) == 1 and all(s != "R0" for s, _ in asked[0])
    assert rows(layer.read_fresh("blocks", 500.0, fetch, now=1100.0)) == fresh and len(asked) == 1  # 300 and 400 seconds old
    gone = lambda parts: views.layer_rows(after).where("false")
    assert layer.read_fresh("blocks", 1.0, gone, now=9000.0).count() == 0 and not layer.manifest().parts


def test_a_second_writer_of_a_version_fails(spark, layer):
    layer.replace(views.layer_rows(some(spark, 0, 50)))
    some(spark, 0, 5).write.parquet(f"{layer.path}/partials/version=2/state=X/month=2024-01")
    with pytest.raises(Exception, match="(?i)already exists"):
        layer.add(views.layer_rows(some(spark, 50, 60)))
    assert layer.manifest().version == 1
    assert rows(layer.read("blocks")) == direct(layer, some(spark, 0, 50))


def test_views_read_the_layer(spark):
    v = views.Views(spark, "/root/testdata/sf0.001")
    for df in (v.load, v.sldc, v.wloc, v.wmean, v.frame, v.grid):
        assert "events.parquet" not in df._jdf.queryExecution().executedPlan().toString()
    raw = v.ev.groupBy("state", "date", "block").agg(F.round(F.sum("value"), 4).alias("load"))
    assert sorted(map(tuple, raw.collect()), key=repr) == sorted(map(tuple, v.load.collect()), key=repr)
