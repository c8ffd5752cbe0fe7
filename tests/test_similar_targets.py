"""Similar days of all targets against the queries for one target."""

import math

import pytest
from helpers import DAY0, day
from pyspark.sql import functions as F

from quarterhour.operators import similar_targets as targets
from quarterhour.operators import similarity as sim


def blocks(spark, days, every=24, first=0):
    """Days with weather that comes near itself now and then, two states, gaps, holidays, rain and a low day."""
    rows = []
    for s, state in enumerate(("A", "B")):
        for d in range(first, first + days):
            if (d * 7 + s) % 29 == 3:
                continue  # a day without rows
            for b in range(1, 97, every):
                t = 22 + 9 * math.sin(d * 0.9 + s) + b * 0.02 + (d % 5) * 0.3
                low = d % 31 == 11
                rows.append((state, day(d), b, None if (d + b) % 41 == 0 else (5.0 if low else 400.0 + 3 * t + (d % 7) * 8), None if (d * b) % 37 == 5 else t, 50 + 20 * math.cos(d * 0.7), float(d % 6 == 0), 10.0 + (d % 11) * 3, int(d % 17 == 4)))
    return spark.createDataFrame(rows, "state string, date date, block int, load double, temperature double, humidity double, precipitation double, wind_speed_10m double, is_holiday int")


def near(rows, *cols):
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in rows)


def test_pools_and_baselines_equal_the_single_target(spark):
    """Two years, so that the months of the year before take part; a date in each season, weekends and holidays among them."""
    df = blocks(spark, 60, first=0).unionByName(blocks(spark, 75, first=355)).cache()
    everything = targets.similar_day_pools(targets.day_features(df), min_level=100.0).cache()
    base = targets.similar_day_baselines(df, everything).cache()
    cols = ("state", "date", "pool", "tier", "score", "rank", "scale", "weight")
    pools = set()
    for d in (5, 33, 55, 361, 370, 377, 379, 400, 424, 428):
        target = str(day(d))
        one = sim.similar_day_pool(sim.day_features(df, *sim.degree_bases(target)), target)
        all_ = everything.where(F.col("target") == F.lit(target).cast("date"))
        assert near(one.collect(), *cols) == near(all_.collect(), *cols)
        assert near(sim.similar_day_baseline(df, one).collect(), "state", "block", "baseline", "days") == near(base.where(F.col("target") == F.lit(target).cast("date")).collect(), "state", "block", "baseline", "days")
        pools |= {r.pool for r in all_.collect()}
    assert pools == {"recent_7", "current_month"}
    some = targets.similar_day_pools(targets.day_features(df), str(day(360)), str(day(365)), min_level=100.0)
    assert near(some.collect(), "target", *cols) == near(everything.where(F.col("target").between(day(360), day(365))).collect(), "target", *cols)


def test_nothing_from_the_target_day_on_is_used(spark):
    df, cut = blocks(spark, 40), day(30)
    changed = df.withColumn("load", F.when(F.col("date") >= F.lit(cut), F.col("load") * 5).otherwise(F.col("load")))
    one, two = (targets.similar_day_baselines(x, targets.similar_day_pools(targets.day_features(x))).where(F.col("target") <= F.lit(cut)) for x in (df, changed))
    assert near(one.collect(), "state", "target", "block", "baseline") == near(two.collect(), "state", "target", "block", "baseline")


@pytest.mark.parametrize("method", ["euclidean", "weighted", "cosine"])
def test_profiles_equal_the_single_target(spark, method):
    """More days than one block of candidates holds."""
    df = blocks(spark, 160, every=1 if method == "euclidean" else 2).drop("load").cache()
    everything = targets.similar_profiles(df, method=method, k=4, min_coverage=0.3).cache()
    cols = ("state", "date", "distance", "coverage", "rank", "day_of_week")
    assert targets.DAYS_TOGETHER * 2 < 160
    for d in (1, 40, 64, 65, 128, 159):
        one = sim.similar_days(df, str(day(d)), method, 4, 0.3).collect()
        assert near(one, *cols) == near(everything.where(F.col("target") == F.lit(day(d))).collect(), *cols)
    assert everything.where(F.col("target") == F.lit(DAY0)).count() == 0
