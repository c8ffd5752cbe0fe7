"""Isolation forests against plain trees, and what they find."""

import collections

import numpy as np
import pytest
from helpers import DAY0, day, series
from pyspark.sql import functions as F

from quarterhour.operators import isolation as iso


def points(spark, days=20):
    odd = {(7, 40): 5000.0, (13, 5): -900.0}
    df = series(spark, days, lambda d, b: odd.get((d, b), 500 + 100 * np.sin(b / 15) + (d * 37 + b * 11) % 23 if (d + b) % 17 else None))
    other = series(spark, 2, lambda d, b: float(b), "B", range(1, 9))
    return df.unionByName(other).withColumns({"hour": F.floor((F.col("block") - 1) / 4).cast("int"), "dow": F.weekday("date")})


def test_samples_cover_all_days_evenly(spark):
    df = points(spark)
    drawn = iso.samples(df, ["load", "hour", "dow"], 40, 256).collect()
    per_tree = collections.Counter((r.state, r.tree) for r in drawn)
    assert {n for (s, _), n in per_tree.items() if s == "A"} == {256} and {n for (s, _), n in per_tree.items() if s == "B"} == {16}
    by_day = collections.Counter(r.date for r in drawn if r.state == "A")
    assert len(by_day) == 20 and min(by_day.values()) > 0.7 * max(by_day.values())
    assert all(None not in r.x for r in drawn)
    again = iso.samples(df.repartition(13), ["load", "hour", "dow"], 40, 256).collect()
    assert sorted(map(tuple, drawn), key=repr) == sorted(map(tuple, again), key=repr)


def test_scores_equal_a_plain_walk(spark):
    df = points(spark)
    got = {(r.state, r.date, r.block): r.score for r in iso.isolation_scores(df, trees=15, sample=64).collect()}
    trees = collections.defaultdict(list)
    for t in iso.forest(iso.samples(df, ["load", "hour", "dow"], 15, 64)).collect():
        trees[t.state].append(t)
    size = {"A": 64, "B": 16}
    for r in df.collect():
        if r.load is None:
            assert got[r.state, r.date, r.block] is None
            continue
        total = 0.0
        for t in trees[r.state]:
            n = 0
            while t.feature[n] >= 0:
                n = t.left[n] if (r.load, r.hour, r.dow)[t.feature[n]] <= t.cut[n] else t.right[n]
            total += t.path[n]
        assert got[r.state, r.date, r.block] == pytest.approx(2 ** (-total / 15 / iso.average_path(size[r.state])))


def test_outliers_are_found_and_gaps_are_not(spark):
    df = points(spark)
    rows = iso.isolation_scores(df, contamination=0.005).collect()
    a = [r for r in rows if r.state == "A"]
    hits = {(r.date, r.block) for r in a if r.is_anomaly}
    assert {(day(7), 40), (day(13), 5)} <= hits and len(hits) <= 0.005 * len(a) + 1
    assert len(rows) == df.count() and all((r.score is None) == (r.load is None) and (r.score is None or 0 < r.score < 1) for r in rows)
    assert all(not r.is_anomaly for r in rows if r.load is None)


def test_trees_part_their_samples():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(200, 2)), 1)
    tree = iso.grow(x, np.random.default_rng(1))
    arrays = [np.asarray(tree[k]) for k in ("feature", "cut", "left", "right", "path")]
    depth = iso.path_lengths(x, *arrays)
    assert depth.min() >= 1 and max(tree["path"]) <= 8 + iso.average_path(200) and len(tree["feature"]) <= 511
    assert iso.grow(np.ones((9, 2)), rng)["feature"] == [-1] and iso.average_path(1) == 0 and iso.average_path(2) == 1


def test_empty_and_lone_rows(spark):
    empty = points(spark).limit(0)
    assert iso.isolation_scores(empty).count() == 0
    lone = series(spark, 1, lambda d, b: 4.0, blocks=[1]).withColumns({"hour": F.lit(0), "dow": F.lit(0)})
    assert [(r.date, r.score, r.is_anomaly) for r in iso.isolation_scores(lone).collect()] == [(DAY0, 0.5, False)]
