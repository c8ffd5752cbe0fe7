import datetime

from helpers import as_dict, day, series
from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.operators import accuracy, baselines, corrections, quality, similarity
from quarterhour.operators.anomaly import sigma_clamp
from quarterhour.operators.baselines import relative_band
from quarterhour.operators.calendar import holiday_distance
from quarterhour.operators.decompose import ramp_limited
from quarterhour.operators.grid import dense_grid
from quarterhour.operators.weather import HeatLimits, degree_hours, state_weather
from quarterhour.plans.design import design_matrix
from quarterhour.plans.forecast import reference


def no_holidays(spark):
    return spark.createDataFrame([(datetime.date(1990, 1, 1),)], "holiday date")


def test_recent_day_picks_same_type_days(spark):
    g = series(spark, 21)
    got = as_dict(baselines.recent_day(g, no_holidays(spark), 1).where("block = 1"), ["date"], "forecast")
    assert got[day(14)] == (11 + 10 + 9) / 3 and got[day(19)] == (13 + 12 + 6) / 3
    assert got[day(1)] == 0.0  # too little history: plain last days


def test_design_never_sees_load_after_the_origin(spark):
    hol = dims.holidays(spark)
    a = series(spark, 20, lambda d, b: d * 7 + b % 13)
    b = series(spark, 20, lambda d, b: (d * 7 + b % 13) if d <= 15 else 99999.0)
    for h in (1, 2):
        x, y = (design_matrix(dense_grid(s), None, hol, h).where(F.col("date") == F.lit(day(15 + h))).drop("load").orderBy("block").collect() for s in (a, b))
        assert x == y and len(x) == 96


def test_holiday_distance_has_no_cutoff(spark):
    days = spark.createDataFrame([(day(i),) for i in (-800, -1, 0, 1, 366, 367, 2000)], "date date")
    one = spark.createDataFrame([(day(0),)], "holiday date")
    got = {r.date: (r.days_to_holiday, r.days_since_holiday) for r in holiday_distance(days, one).collect()}
    assert got == {day(-800): (800, 999), day(-1): (1, 999), day(0): (0, 0), day(1): (999, 1), day(366): (999, 366), day(367): (999, 367), day(2000): (999, 2000)}
    capped = {r.date: (r.days_to_holiday, r.days_since_holiday) for r in holiday_distance(days, one, cap=7).collect()}
    assert capped[day(367)] == (7, 7) and capped[day(1)] == (7, 1)
    assert dims.holidays(spark).where("year(holiday) in (1950, 2031, 2199)").count() == 9


def test_bands_never_see_load_after_the_origin(spark):
    hol = no_holidays(spark)
    a = series(spark, 30, lambda d, b: 100 + (d * 37) % 11 + b % 13)
    b = series(spark, 30, lambda d, b: (100 + (d * 37) % 11 + b % 13) if d <= 19 else 99999.0)
    for h in (1, 2):
        x, y = (relative_band(reference(dense_grid(s), hol, h), "point", h, window=14, min_rows=300).where(F.col("date") <= F.lit(day(19 + h))).select("date", "block", "p10", "p50", "p90").orderBy("date", "block").collect() for s in (a, b))
        assert x == y and len(x) == 96 * (20 + h) and any(r.p10 != r.p50 * 0.95 for r in x if r.p50)


def test_similar_days_keep_to_their_own_type(spark):
    rows = [("A", day(i), 100.0 + i % 3, 20.0 + i % 5, 50.0, 0.0, 0.0, 0, 1.0, int(i % 60 == 9), int(i == 364)) for i in range(730)]
    days = spark.createDataFrame(rows, "state string, date date, level double, t double, h double, cdd double, hdd double, rain int, wind double, is_holiday int, synthetic int")
    assert len(similarity.last_year_days(days, "2025-02-08").collect()) == 15
    assert similarity.degree_bases("2024-07-01") == (20.0, 12.0) and similarity.degree_bases("2024-11-01") == (22.0, 15.0)
    plain = similarity.similar_day_pool(days, "2025-01-06", top=60, anomaly_limit=9.0).collect()
    assert day(364) not in {r.date for r in plain} and day(365) in {r.date for r in plain}  # a synthetic day is no candidate
    many = days.withColumn("is_holiday", (F.dayofmonth("date") % 2 == 1).cast("int"))  # plenty of them: a holiday keeps to holidays
    got = similarity.similar_day_pool(many, "2025-02-03", top=20, anomaly_limit=9.0).collect()
    assert got and all(r.date.day % 2 == 1 for r in got)
    fewer = days.where((F.weekday("date") == 5) | (F.year("date") < 2025))  # the last seven days on record are Saturdays
    saturdays = similarity.similar_day_pool(fewer, "2025-03-01", top=20, anomaly_limit=9.0).collect()
    assert len(saturdays) >= 4 and all(r.date.weekday() == 5 for r in saturdays)


def test_metrics_and_pinball(spark):
    p = series(spark, 2, lambda d, b: 100).withColumnRenamed("load", "actual").withColumns({"forecast": F.lit(110.0), "p10": F.lit(90.0), "p90": F.lit(130.0)})
    m = accuracy.metrics(p).first()
    assert abs(m["wape"] - 10) < 1e-9 and abs(m["bias_mw"] - 10) < 1e-9 and m["coverage_pct"] == 100 and abs(m["pinball_loss"] - (1 + 5 + 3) / 3) < 1e-9


def test_load_contract(spark):
    rows = series(spark, 3, lambda d, b: -1 if (d, b) == (0, 3) else 5, skip={(1, b) for b in range(1, 97)}).unionByName(series(spark, 1, lambda d, b: 5, blocks=[9]))
    r = quality.load_contract(rows, "2024-01-01", "2024-01-03").first()
    assert (r["expected_blocks"], r["present_blocks"], r["duplicate_blocks"], r["nonpositive_blocks"]) == (288, 192, 1, 1)
    assert r["status"] == "degraded" and r["missing_list"] == "2024-01-02"


def test_forecast_gate(spark):
    def blocks(fn):
        return series(spark, 1, fn).withColumnRenamed("load", "p50").withColumn("p10", F.col("p50") - 1).withColumn("p90", F.col("p50") + 1)
    ok = quality.forecast_gate(blocks(lambda d, b: 100)).first()
    assert ok["status"] == "ok" and ok["big_ramps"] == 0
    assert quality.forecast_gate(blocks(lambda d, b: 100).withColumn("p10", F.lit(500.0))).first()["status"] == "failed"
    assert quality.forecast_gate(blocks(lambda d, b: None if b == 4 else 100)).first()["status"] == "failed"
    assert quality.forecast_gate(blocks(lambda d, b: 5000 if b == 40 else 100)).first()["big_ramps"] == 2


def test_weighted_weather_renormalises(spark):
    rows = [("A", "D0", day(0), 1, 30.0), ("A", "D1", day(0), 1, 20.0), ("A", "D0", day(0), 2, 30.0), ("A", "D1", day(0), 2, None), ("A", "ZZ", day(0), 1, 99.0)]
    w = spark.createDataFrame(rows, "state string, location string, date date, block int, temperature double")
    for c in ("humidity", "precipitation", "cloud_cover", "wind_speed_10m", "direct_radiation"):
        w = w.withColumn(c, F.lit(50.0))
    wt = spark.createDataFrame([("D0", 3.0), ("D1", 1.0)], "location string, weight double")
    s = {r["block"]: r for r in state_weather(w, wt, HeatLimits(hot_temp=25.0)).collect()}
    assert s[1]["temp_wmean"] == 27.5 and s[2]["temp_wmean"] == 30.0 and s[2]["wx_weight_coverage"] == 0.75 and s[1]["hot_share"] == 0.75


def test_degree_hours_rescale(spark):
    w = series(spark, 1, lambda d, b: 28.0, skip={(0, 3), (0, 5)}).withColumnRenamed("load", "temperature").withColumn("location", F.lit("D0"))
    got = as_dict(degree_hours(w, 8), ["block"], "cdh")
    assert got[7] is None and got[8] == 8.0 and got[20] == 8.0


def test_bias_sign_and_settled_blocks(spark):
    e = series(spark, 10, lambda d, b: 20.0).withColumnRenamed("load", "error")
    t = corrections.bias_table(e, "2024-01-11", 7)
    f = series(spark, 1, lambda d, b: 100.0).withColumnRenamed("load", "forecast")
    got = as_dict(corrections.apply_bias(f, t, 10), ["block"], "corrected")
    assert got[10] == 100.0 and got[11] == 80.0


def test_t2_fallback_and_taper(spark):
    e = series(spark, 2, lambda d, b: 0.0).withColumnRenamed("load", "error")
    got = as_dict(corrections.t2_night_table(e), ["block"], "correction")
    assert abs(got[1] - 402.5) < 1e-9 and got[20] == 350.0 and got[49] == 0.0 and got[33] == 0.0
    learned = as_dict(corrections.t2_night_table(series(spark, 8, lambda d, b: -10.0).withColumnRenamed("load", "error")), ["block"], "correction")
    assert learned[5] == 10.0 and abs(learned[48] - 3.0) < 1e-9 and learned[60] == 0.0


def test_ramp_limit_only_moves_future_blocks(spark):
    f = series(spark, 1, lambda d, b: 1000.0 if b in (5, 60) else 100.0)
    got = as_dict(ramp_limited(f, "load", 50.0, settled=10), ["block"], "limited")
    assert got[5] == 1000.0 and got[60] == 150.0 and got[61] == 100.0


def test_sigma_clamp_pulls_at_most_the_limit(spark):
    p = series(spark, 6, lambda d, b: 100.0).withColumnRenamed("load", "actual").withColumn("forecast", F.when(F.col("date") == F.lit(day(5)), 10000.0).otherwise(100.0))
    got = as_dict(sigma_clamp(p).where("block = 1"), ["date"], "clamped")
    assert abs(got[day(5)] - (10000 * 0.3 + 100 * 0.7)) < 1e-6 and got[day(4)] == 100.0


def test_missing_forecast_stays_missing(spark):
    f = series(spark, 1, lambda d, b: None if b == 50 else 100.0).withColumnRenamed("load", "forecast").withColumn("actual", F.lit(120.0))
    for out, col in ((corrections.momentum_carry(f, 36), "carried"), (corrections.live_ratio(f, 36), "calibrated"), (corrections.intraday_recalibrate(f, 36), "recalibrated")):
        assert as_dict(out, ["block"], col)[50] is None


def test_other_states_and_row_order_change_nothing(spark):
    a = series(spark, 12, lambda d, b: d * 3 + b % 7)
    other = series(spark, 12, lambda d, b: 9000 + b, state="Z")
    hol = no_holidays(spark)
    one = as_dict(baselines.recent_day(a, hol, 1), ["date", "block"], "forecast")
    two = as_dict(baselines.recent_day(other.unionByName(a).orderBy(F.desc("block")), hol, 1).where("state = 'A'"), ["date", "block"], "forecast")
    assert one == two


def test_doubling_load_keeps_percentages(spark):
    a = series(spark, 15, lambda d, b: 50 + d * 3 + b % 7)
    def wape(df):
        return accuracy.metrics(corrections.lagged_pair(df)).first()
    x, y = wape(a), wape(a.withColumn("load", F.col("load") * 2))
    assert abs(x["wape"] - y["wape"]) < 1e-9 and abs(2 * x["mae"] - y["mae"]) < 1e-9


# --- weekly refits -----------------------------------------------------------------------------------------------


def _refit_case(spark, days=70):
    """Load that follows the temperature of the day, which the baselines cannot see."""
    import math
    temp = {(d, b): 20 + 8 * math.sin(d * 1.7) + 0.05 * b for d in range(days) for b in range(1, 97)}
    load = lambda d, b: 500 + 2 * b + 6 * (temp[d, b] - 20) + ((d * 31 + b * 17) % 7)
    grid = series(spark, days, load, blocks=range(1, 97, 12))
    weather = spark.createDataFrame([("A", day(d), b, float(t)) for (d, b), t in temp.items() if b % 12 == 1], "state string, date date, block int, temperature double")
    return grid, weather, dims.holidays(spark)


def test_refitted_models_beat_the_baselines(spark):
    from quarterhour.plans import refit
    grid, weather, hol = _refit_case(spark)
    rows = {(r.model, r.horizon): r for r in refit.fitted_backtest(grid, weather, hol, str(day(42)), str(day(69)), min_history_days=28).collect()}
    assert set(rows) == {(m, h) for m in ("seasonal_naive", "recent_day", "ridge_residual", "ridge_direct") for h in (1, 2)}
    for h in (1, 2):
        assert rows["ridge_residual", h].wape < 0.8 * min(rows["seasonal_naive", h].wape, rows["recent_day", h].wape)
        assert 50 < rows["ridge_residual", h].coverage_pct <= 100 and rows["recent_day", h].pinball_loss is None


def test_refits_read_nothing_after_their_anchor(spark):
    from quarterhour.plans import refit
    grid, weather, hol = _refit_case(spark, 49)
    start, end = str(day(30)), str(day(48))

    def run(g):
        got = refit.fitted_forecasts(refit.supervised(g, weather, hol), start, end).collect()
        return {(r.date, r.block, r.horizon, r.model): (r.forecast, r.p10, r.p90, r.fit) for r in got}

    before, cut = run(grid), day(39)
    after = run(grid.withColumn("load", F.when(F.col("date") > F.lit(cut), F.col("load") * 9 + 1000).otherwise(F.col("load"))))
    early = [k for k in before if (k[0] - cut).days <= k[2]]  # origins up to the cut
    assert early and all(before[k] == after[k] for k in early)
    assert any(before[k] != after[k] for k in before if k not in set(early))


def test_refit_sums_equal_plain_regressions(spark):
    import numpy as np

    from quarterhour.plans import refit
    grid, weather, hol = _refit_case(spark, 60)
    start = day(30)
    rows = refit.supervised(grid, weather, hol, (1,))
    got = {(r.date, r.block): r for r in refit.fitted_forecasts(rows, str(start), str(day(59)), (refit.RESIDUAL,), train_weeks=3).collect()}
    table = [r for r in rows.collect() if all(r[c] is not None for c in ("residual", "dev_h", "dev_7d", "temp_change"))]
    for target in (day(30), day(37), day(43), day(59)):
        for block in (1, 49):
            anchor = start - datetime.timedelta(1) + datetime.timedelta(7 * ((target - start).days // 7))
            train = [r for r in table if r.block == block and anchor - datetime.timedelta(21) < r.date <= anchor]
            x, y = np.array([[r.dev_h, r.dev_7d, r.temp_change] for r in train]), np.array([r.residual for r in train])
            sd = x.std(axis=0)
            z = (x - x.mean(axis=0)) / sd
            beta = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean())) / sd
            own = next(r for r in table if r.block == block and r.date == target)
            want = own.reference + y.mean() + (np.array([own.dev_h, own.dev_7d, own.temp_change]) - x.mean(axis=0)) @ beta
            assert len(train) == 21 and got[target, block].fit == "block" and abs(got[target, block].forecast - want) < 1e-6
