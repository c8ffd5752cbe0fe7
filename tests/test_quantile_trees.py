"""Quantile trees: a plain grower, quantiles that differ by region, and coverage on later days."""

import datetime
import random

import numpy as np
import pytest
from helpers import day, series
from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.operators import quantile_trees as qt
from quarterhour.plans import forecast


def test_trees_equal_a_plain_grower(spark):
    rnd = random.Random(1)
    rows = [("AB"[i % 2], float(rnd.randint(0, 9)), None if i % 13 == 0 else float(rnd.randint(0, 5)), 0.0) for i in range(600)]
    rows = [(s, a, b, (a * 3 if s == "A" else -a) + (b or 4) + rnd.gauss(0, 1 + a)) for s, a, b, _ in rows]
    df = spark.createDataFrame(rows, "state string, a double, b double, y double").repartition(5)
    model = qt.fit(df, ["a", "b"], "y", rounds=2, depth=2, rate=0.5, bins=8, min_leaf=15)
    for s in "AB":
        own = [r for r in rows if r[0] == s]
        y = np.array([r[3] for r in own])
        x = np.array([[0 if v is None else 1 + sum(e < v for e in edges) for v, edges in zip(r[1:3], model.edges[s])] for r in own])
        for q, alpha in enumerate(qt.LEVELS):
            f = np.full(len(y), np.quantile(y, alpha))
            assert model.start[s, q] == pytest.approx(f[0])
            for tree in model.trees[s, q]:
                g, groups, leaf = alpha - (y < f), [np.arange(len(y))], np.zeros(len(y))
                for level in range(2):
                    parts = []
                    for k, group in enumerate(groups):
                        best = None
                        for col in range(2):
                            for cut in range(10):
                                left = group[x[group, col] <= cut]
                                right = group[x[group, col] > cut]
                                if min(len(left), len(right)) >= 15:
                                    gain = round(g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[group].sum() ** 2 / len(group), 9)
                                    if gain > 0 and (best is None or gain > best[0]):
                                        best = (gain, col, cut)
                        node = 2**level - 1 + k
                        if best:
                            assert (tree.feature[node], tree.bin[node]) == best[1:] or np.array_equal(x[group, best[1]] <= best[2], x[group, tree.feature[node]] <= tree.bin[node])
                        parts += [group[x[group, tree.feature[node]] <= tree.bin[node]], group[x[group, tree.feature[node]] > tree.bin[node]]]
                    groups = parts
                for k, group in enumerate(groups):
                    if len(group):
                        leaf[group] = np.quantile((y - f)[group], alpha)
                        assert tree.leaf[k] == pytest.approx(leaf[group][0])
                f = f + 0.5 * leaf


def _series(spark, days=84):
    """Noise that is wide in state B and narrow in A, wider at high temperature, and one-sided in blocks above 48."""
    rnd = random.Random(5)
    temp = {d: 20 + 6 * np.sin(d * 1.3) for d in range(days)}
    noise = {(s, d, b): rnd.gauss(0, 1) for s in "AB" for d in range(days) for b in range(1, 97, 6)}
    load = {s: (lambda d, b, s=s, w=w: 300 + b + 4 * (temp[d] - 20) + w * (2 if temp[d] > 22 else 1) * (abs(noise[s, d, b]) if b > 48 else noise[s, d, b])) for s, w in (("A", 2), ("B", 12))}
    grid = series(spark, days, load["A"], "A", range(1, 97, 6)).unionByName(series(spark, days, load["B"], "B", range(1, 97, 6)))
    weather = spark.createDataFrame([(s, day(d), b, float(temp[d])) for s in "AB" for d in range(days) for b in range(1, 97, 6)], "state string, date date, block int, temperature double")
    return grid, weather, dims.holidays(spark)


def test_coverage_and_loss_on_later_days(spark):
    grid, weather, hol = _series(spark)
    start = day(63)
    out, model = forecast.quantile_forecast(forecast.quantile_rows(grid, weather, hol), str(start), rounds=10)
    rows = [r for r in out.collect() if r.load is not None]
    assert len(rows) == 2 * 21 * 16 and all(0 <= r.p10 <= r.p50 <= r.p90 for r in rows)
    width = {}
    for s in "AB":
        own = [r for r in rows if r.state == s]
        inside = sum(r.p10 <= r.load <= r.p90 for r in own) / len(own)
        assert 0.65 < inside < 0.92, (s, inside)
        for c, alpha in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)):
            loss = lambda e: max(alpha * e, (alpha - 1) * e)  # noqa: E731, B023
            got, plain = sum(loss(r.load - r[c]) for r in own), sum(loss(r.load - r.reference - model.start[s, qt.LEVELS.index(alpha)]) for r in own)
            assert got < plain
        width[s] = np.mean([r.p90 - r.p10 for r in own])
    assert width["B"] > 1.5 * width["A"]


def test_later_days_change_nothing(spark):
    grid, weather, hol = _series(spark, 56)
    start, cut = str(day(42)), day(41)
    changed = grid.withColumn("load", F.when(F.col("date") > F.lit(cut), F.col("load") * 3).otherwise(F.col("load")))
    one, two = (forecast.quantile_forecast(forecast.quantile_rows(g, weather, hol), start, rounds=3)[0].where(F.col("date") == F.lit(day(42))) for g in (grid, changed))
    pick = lambda df: sorted((r.state, r.block, r.p10, r.p50, r.p90) for r in df.collect())
    assert pick(one) == pick(two) and datetime.date.fromisoformat(start) == day(42)


def test_awkward_input(spark):
    empty = spark.createDataFrame([], "state string, a double, y double")
    model = qt.fit(empty, ["a"], "y", rounds=1)
    assert not model.trees and qt.predict(spark.createDataFrame([("A", 1.0)], "state string, a double"), model, ["a"]).head().quantiles is None
    same = spark.createDataFrame([("A", None, 7.0)] * 50 + [(None, 1.0, 3.0), ("A", 1.0, None)], "state string, a double, y double")
    model = qt.fit(same, ["a"], "y", rounds=2)
    assert qt.predict(same, model, ["state", "a"]).where("state = 'A'").distinct().head().quantiles == [7.0, 7.0, 7.0]
