"""Weather clusters where the calm days are few or none."""

import pytest
from helpers import day

from quarterhour.operators.clusters import weather_clusters
from quarterhour.operators.weather import storm_days

WEATHER = "state string, date date, block int, temperature double, humidity double, precipitation double, wind_speed_10m double"
STORM = {0: (3, "Storm"), 1: (3, "Storm")}


def clustered(spark, calm):
    """Two storm days, by rain and by wind, and the calm days of the given temperatures: (cluster, name) by day."""
    days = [(25.0, 60.0, 10.0, 5.0), (20.0, 60.0, 0.0, 90.0)] + [(t, 50.0, 0.0, 5.0) for t in calm]
    frame = spark.createDataFrame([("A", day(i), b, *w) for i, w in enumerate(days) for b in (1, 2)], WEATHER)
    rows = weather_clusters(frame, storm_days(frame)).collect()
    got = {(r.date - day(0)).days: (r.cluster, r.cluster_name) for r in rows}
    assert len(got) == len(rows) and {(r.date - day(0)).days: r.avg_temp for r in rows} == {i: days[i][0] for i in got}
    return got


@pytest.mark.parametrize("calm", [[], [None, None]], ids=["only storms", "calm days without readings"])
def test_storm_days_are_the_result_where_no_calm_day_can_be_clustered(spark, calm):
    assert clustered(spark, calm) == STORM


def test_fewer_different_calm_days_than_clusters(spark):
    assert clustered(spark, [30.0]) == STORM | {2: (0, "Hot-Dry")}
    assert clustered(spark, [10.0, 30.0, 30.0, None]) == STORM | {2: (1, "Pre-Monsoon Humid"), 3: (0, "Hot-Dry"), 4: (0, "Hot-Dry")}


def test_calm_days_are_numbered_from_hot_to_cool(spark):
    assert clustered(spark, [10.0, 40.0, 25.0, 40.5]) == STORM | {2: (2, "Rainy"), 3: (0, "Hot-Dry"), 4: (1, "Pre-Monsoon Humid"), 5: (0, "Hot-Dry")}
