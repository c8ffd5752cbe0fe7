import datetime
import itertools
import random

from helpers import as_dict, day, series
from pyspark.sql import functions as F

from quarterhour.functions import physics
from quarterhour.functions.stats import rank_corr, windowed_median
from quarterhour.operators import clean, merge
from quarterhour.operators.grid import blocks_back, core_rows, day_lag, dense_grid, interpolate, rolling, run_ids, run_length_so_far, sliced
from quarterhour.operators.peaks import peaks_by_prominence
from quarterhour.sources import normalise


def test_wet_bulb_reference_values(spark):
    r = spark.createDataFrame([(20.0, 50.0), (25.0, 60.0), (25.0, 2.0), (60.0, 50.0), (None, 50.0)], "t double, h double").select(physics.wet_bulb("t", "h").alias("w")).collect()
    assert abs(r[0].w - 13.7) < 0.05 and r[2].w is None and r[3].w is None and r[4].w is None
    d = spark.createDataFrame([(25.0, 60.0), (25.0, 0.0)], "t double, h double").select(physics.dew_point("t", "h").alias("d")).collect()
    assert abs(d[0].d - 16.7) < 0.05 and d[1].d is None


def test_day_lag_needs_the_exact_day(spark):
    df = series(spark, 5, lambda d, b: d * 100 + b, skip={(2, 7)})
    got = as_dict(df.withColumn("l", day_lag("load", 1)), ["date", "block"], "l")
    assert got[(day(1), 7)] == 7 and got[(day(3), 7)] is None and got[(day(0), 7)] is None


def test_block_lag_crosses_midnight_and_slices_agree(spark):
    df = series(spark, 9, lambda d, b: d * 96 + b)
    for width in (1, 3, 28):
        s = core_rows(sliced(df, back=96, slice_days=width).withColumns({"p": blocks_back("load", 1), "m": rolling(F.avg("load"), 96)}))
        assert s.count() == 9 * 96
        p, m = as_dict(s, ["date", "block"], "p"), as_dict(s, ["date", "block"], "m")
        assert p[(day(3), 1)] == 3 * 96 and p[(day(0), 1)] is None
        assert m[(day(2), 10)] == sum(range(2 * 96 + 10 - 95, 2 * 96 + 11)) / 96


def test_interpolation_holds_edges_and_leaves_empty_groups(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 4, 20.0), ("a", 5, None), ("b", 1, None)], "state string, i int, v double")
    got = as_dict(interpolate(df, "v", ["state"], "i"), ["state", "i"], "v")
    assert [got[("a", i)] for i in range(1, 6)] == [10.0, 10.0, 15.0, 20.0, 20.0] and got[("b", 1)] is None


def test_dense_grid_fills_missing_day(spark):
    g = dense_grid(series(spark, 3, skip={(1, b) for b in range(1, 97)}))
    assert g.count() == 288 and g.where("load is null").count() == 96


def test_runs(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1])], "state string, i int, f int")
    r = as_dict(run_length_so_far(df, F.col("f") == 1, ["state"], "i", "n"), ["i"], "n")
    assert [r[i] for i in range(6)] == [1, 2, 0, 1, 2, 3]
    assert run_ids(df, F.col("f"), ["state"], "i").select("run_id").distinct().count() == 3


def test_rank_correlation_ties_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 5.0), ("a", 2.0, 2.0, 5.0), ("a", 3.0, 9.0, 5.0), ("a", None, 1.0, 5.0)], "state string, x double, y double, c double")
    got = as_dict(rank_corr(df, ["state"], {"xy": ("x", "y"), "xc": ("x", "c"), "xx": ("x", "x")}), ["pair"], "rho")
    assert abs(got["xy"] - 0.8660254) < 1e-6 and got["xc"] == 0.0 and abs(got["xx"] - 1.0) < 1e-12


def test_windowed_median(spark):
    from pyspark.sql import Window
    df = series(spark, 1, lambda d, b: [5, 1, 9, 3][b - 1], blocks=range(1, 5))
    w = Window.partitionBy("state", "date").orderBy("block").rowsBetween(-1, 1)
    got = as_dict(df.withColumn("m", windowed_median("load", w)), ["block"], "m")
    assert got == {1: 3.0, 2: 5.0, 3: 3.0, 4: 6.0}


def test_priority_merge_uses_feed_up_to_its_last_block(spark):
    a = series(spark, 1, lambda d, b: 100 + b, blocks=[1, 2, 4])
    b = series(spark, 1, lambda d, b: b, blocks=[2, 3, 4, 5])
    got = as_dict(merge.priority_merge(a, b), ["block"], "load")
    assert got == {1: 101.0, 2: 102.0, 3: 3.0, 4: 104.0, 5: 5.0}


def test_spikes_and_short_drops(spark):
    base = series(spark, 1, lambda d, b: 1000 if b == 50 else 100)
    fixed = as_dict(clean.fix_spikes(base, threshold=300.0, strict=True), ["block"], "load")
    assert fixed[50] == 100.0
    dips = series(spark, 1, lambda d, b: 10 if b in (20, 21) or 60 <= b <= 66 else 100)
    got = as_dict(clean.smooth_drops(dips, delta=50.0, factor=0.9), ["block"], "load")
    assert got[20] == 100.0 and got[63] == 10.0


def test_normaliser_aliases_and_duplicates(spark):
    raw = spark.createDataFrame([("A", "2024-01-01", "00:10", "5"), ("A", "2024-01-01", "00:12", "7"), ("A", "2024-01-01", "23:50", "x"), ("A", "bad", "01:00", "1")], "state string, date string, hm string, demand_mw string")
    raw = raw.withColumn("timestamp", F.try_to_timestamp(F.concat("date", F.lit(" "), "hm"), F.lit("yyyy-MM-dd HH:mm")))
    got = {r["block"]: (r["load"], r["duplicates"]) for r in normalise.load_rows(raw).collect()}
    assert got == {1: (6.0, 1), 96: (None, 0)}
    names = spark.createDataFrame([(" gurgaon ",), ("Yamuna_Nagar",), ("x-y",)], "n string").select(normalise.canonical_district("n").alias("c"))
    assert [r.c for r in names.collect()] == ["GURUGRAM", "YAMUNANAGAR", "X Y"]


def test_zero_based_blocks_shift_only_when_certain(spark):
    z = series(spark, 1, lambda d, b: b, blocks=range(0, 96))
    assert normalise.one_based_blocks(z).agg(F.max("block")).first()[0] == 96
    p = series(spark, 1, lambda d, b: b, blocks=range(1, 97))
    assert normalise.one_based_blocks(p).agg(F.min("block")).first()[0] == 1


def brute_prominence(v, limit):
    out = {}
    for i in range(1, len(v) - 1):
        if v[i] > v[i - 1] and v[i] > v[i + 1]:
            lo, mins = i, []
            for step in (-1, 1):
                j, m = i, v[i]
                while 0 <= j + step < len(v) and v[j + step] <= v[i]:
                    j += step
                    m = min(m, v[j])
                mins.append(m)
            if v[lo] - max(mins) >= limit:
                out[i] = v[i] - max(mins)
    return out


def test_prominence_matches_brute_force(spark):
    vals = [(17 * i * i + 31 * i) % 101 for i in range(96 * 3)]
    df = series(spark, 3, lambda d, b: vals[d * 96 + b - 1])
    got = {(r["date"] - datetime.date(2024, 1, 1)).days * 96 + r["block"] - 1: r["prominence"] for r in peaks_by_prominence(df, 40.0).collect()}
    assert got == brute_prominence(vals, 40.0) and len(got) > 5


def test_prominence_across_slices(spark, monkeypatch):
    """Slices of one day: peaks whose valleys, higher readings and level tops lie slices away; gaps, level series, two states."""
    from quarterhour.operators import peaks as module
    monkeypatch.setattr(module, "SLICE_DAYS", 1)
    rnd = random.Random(6)
    days = 9
    vals = [float(rnd.randint(0, 30)) * 5 for _ in range(96 * days)]
    vals[300:420] = [70.0] * 120  # a level run over two slices
    vals[500], vals[700], vals[95:98], vals[191:193] = 400.0, 401.0, [155.0] * 3, [500.0, 500.0]
    base = datetime.date(2024, 1, 1)
    rows = [("A", base + datetime.timedelta(i // 96), i % 96 + 1, None if i % 23 == 7 else v) for i, v in enumerate(vals)] + [("B", base + datetime.timedelta(i // 96), i % 96 + 1, 5.0) for i in range(400)]
    rows += [("C", base, 1, 1.0), ("C", base + datetime.timedelta(3), 1, 9.0), ("C", base + datetime.timedelta(8), 1, 2.0)]
    got = peaks_by_prominence(spark.createDataFrame(rows, "state string, date date, block int, load double"), 60.0, keys=("state",)).collect()
    known = [(i, v) for i, v in enumerate(vals) if i % 23 != 7]
    runs = [(v, [i for i, _ in g]) for v, g in itertools.groupby(known, key=lambda x: x[1])]
    want = {runs[k][1][(len(runs[k][1]) + 1) // 2 - 1]: p for k, p in brute_prominence([v for v, _ in runs], 60.0).items()}
    assert {(r.date - base).days * 96 + r.block - 1: r.prominence for r in got if r.state == "A"} == want and len(want) > 20
    assert not [r for r in got if r.state == "B"]
    low = peaks_by_prominence(spark.createDataFrame(rows, "state string, date date, block int, load double").where("state = 'C'"), 5.0).collect()
    assert [(r.date, r.block, r.load, r.prominence) for r in low] == [(base + datetime.timedelta(3), 1, 9.0, 7.0)]
