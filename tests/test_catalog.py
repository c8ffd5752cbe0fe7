"""Registered queries against their SQL twins. QH_ALL=1 runs every one, otherwise a few per section."""

import os

import pytest
from compare import check

import __spark_entry__ as entry

QUERIES, TWINS = entry.queries(), entry.oracle_sql()
PICK = ["a1_filtered_scan", "a10_load_rows", "b5_valid_prefix", "b12_tertiles", "c1_priority_merge", "c11_day_lags", "d10_load_state", "d29_tab_trend", "d42_spearman_matrix", "e8_lags_and_changes",
        "e16_ramp_limiter", "f8_guarded_lags", "g3_short_drops", "h1_load_contract", "i3_level_shift_days", "i6_peaks_by_prominence", "j1_state_weather_features", "k2_recent_day", "k13_causal_rotated_baseline", "l7_partial_day_correction", "m6_rolling_origin_backtest",
        "n11_deviation_curves", "o1_similar_days_cosine", "p1_two_feature_ols", "q5_peak_window", "r7_episodes", "s18_arrays", "t2_external_forecast"]
NAMES = list(QUERIES) if os.environ.get("QH_ALL") else PICK


def test_every_twin_binds(duck):
    for name, sql in TWINS.items():
        duck.execute("EXPLAIN " + sql)
        assert name in QUERIES


def test_registry_covers_every_section():
    assert {n[0] for n in QUERIES} >= set("abcdefghijklmnopqrst")
    assert len(TWINS) / len(QUERIES) > 0.9


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, duck, name):
    msg, _, ok = check(name, spark, duck, "/root/testdata/sf0.001", QUERIES, TWINS)
    assert ok or "rows-only" in msg, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns[:3] == ["state", "model", "horizon"] and {r["horizon"] for r in rows} and len(rows) == len({tuple(r)[:3] for r in rows}) > 4
