"""2.Q calendar."""

from pyspark.sql import functions as F

from quarterhour.catalog.core import query
from quarterhour.operators import calendar as cal

_D = "d AS (SELECT DISTINCT date FROM v_daily)"


@query("q1_calendar_fields", "date day_name month_name iso_week:i quarter:i day_of_year:i dow_sin:f month_cos:f four what_if backtest", f"""
    WITH {_D} SELECT date, dayname(date) AS day_name, monthname(date) AS month_name, week(date) AS iso_week, quarter(date) AS quarter, dayofyear(date) AS day_of_year,
      sin(2 * pi() * (isodow(date) - 1) / 7) AS dow_sin, cos(2 * pi() * (month(date) - 1) / 12) AS month_cos,
      CASE WHEN month(date) IN (12,1,2) THEN 'winter' WHEN month(date) <= 5 THEN 'spring' WHEN month(date) <= 8 THEN 'summer' ELSE 'fall' END AS four,
      CASE WHEN month(date) IN (6,7,8,9) THEN 'monsoon' WHEN month(date) IN (11,12,1,2) THEN 'winter' ELSE 'summer' END AS what_if,
      CASE WHEN month(date) IN (3,4,5) THEN 'Summer' WHEN month(date) IN (6,7,8,9) THEN 'Monsoon' WHEN month(date) IN (10,11) THEN 'Post-Monsoon' ELSE 'Winter' END AS backtest FROM d""")
def _(v):
    four, what_if, backtest = cal.season_maps(F.month("date"))
    return cal.calendar_fields(v.daily.select("date").distinct()).withColumns({"four": four, "what_if": what_if, "backtest": backtest})


@query("q2_holidays_in_range", "holiday days:i", "SELECT h.holiday, count(*) AS days FROM v_hol h JOIN (SELECT DISTINCT state, date FROM v_daily) d ON d.date = h.holiday GROUP BY h.holiday")
def _(v):
    d = v.daily.select("state", "date").distinct()
    return d.join(v.hol, d["date"] == v.hol["holiday"]).groupBy("holiday").agg(F.count(F.lit(1)).alias("days"))


_FLAGS = f"""{_D}, x AS (SELECT date, isodow(date) - 1 AS dow, date IN (SELECT holiday FROM v_hol) AS h, CAST(date + 1 AS DATE) IN (SELECT holiday FROM v_hol) AS n, CAST(date - 1 AS DATE) IN (SELECT holiday FROM v_hol) AS p FROM d),
    g AS (SELECT d.date, coalesce(min(h.holiday - d.date) FILTER (WHERE h.holiday >= d.date), 999) AS days_to_holiday, coalesce(min(d.date - h.holiday) FILTER (WHERE h.holiday <= d.date), 999) AS days_since_holiday FROM d CROSS JOIN v_hol h GROUP BY d.date),
    f AS (SELECT *, CAST(h AS INTEGER) AS is_holiday, CAST(h AND dow = 4 AS INTEGER) AS holiday_before_weekend, CAST(h AND dow = 0 AS INTEGER) AS holiday_after_weekend, CAST(NOT h AND dow < 5 AND (n OR p) AS INTEGER) AS bridge_day,
      CAST(dow >= 5 AND (n OR p) AS INTEGER) AS long_weekend, CAST(h AND dow BETWEEN 1 AND 3 AS INTEGER) AS midweek_holiday FROM x JOIN g USING (date))"""


@query("q3_holiday_flags", "date is_holiday:i holiday_before_weekend:i holiday_after_weekend:i bridge_day:i long_weekend:i midweek_holiday:i days_to_holiday:i days_since_holiday:i", f"WITH {_FLAGS} SELECT * FROM f")
def _(v):
    return cal.transition_flags(v.daily.select("date").distinct(), v.hol)


@query("q3_sparse_holidays", "date days_to_holiday:i days_since_holiday:i", """
    WITH d AS (SELECT DISTINCT date FROM v_daily), h AS (SELECT holiday FROM v_hol WHERE year(holiday) = 1997 AND month(holiday) = 1)
    SELECT date, coalesce(min(holiday - date) FILTER (WHERE holiday >= date), 999) AS days_to_holiday, coalesce(min(date - holiday) FILTER (WHERE holiday <= date), 999) AS days_since_holiday FROM d CROSS JOIN h GROUP BY date""")
def _(v):
    return cal.holiday_distance(v.daily.select("date").distinct(), v.hol.where((F.year("holiday") == 1997) & (F.month("holiday") == 1)))


@query("q4_day_types", "date day_type", f"""
    WITH {_FLAGS} SELECT date, CASE WHEN h THEN CASE WHEN dow = 4 THEN 'Holiday-Fri' WHEN dow = 0 THEN 'Holiday-Mon' WHEN dow BETWEEN 1 AND 3 THEN 'Holiday-MidWeek' ELSE 'Holiday' END WHEN bridge_day = 1 THEN 'BridgeDay' WHEN long_weekend = 1 THEN 'LongWeekend'
      WHEN dow >= 5 THEN 'Weekend' WHEN dow = 4 THEN 'Friday' WHEN dow = 0 THEN 'Monday' ELSE 'Weekday' END AS day_type FROM f""")
def _(v):
    f = cal.transition_flags(v.daily.select("date").distinct(), v.hol)
    return f.withColumn("day_type", cal.day_type(f))


@query("q5_peak_window", "state peak_start:i peak_end:i", """
    WITH m AS (SELECT state, block, median(load) AS m FROM v_load GROUP BY state, block), g AS (SELECT s.state, b.block, m FROM (SELECT DISTINCT state FROM v_load) s CROSS JOIN (SELECT unnest(range(1, 97)) AS block) b LEFT JOIN m USING (state, block)),
    f AS (SELECT state, block, coalesce(last_value(m IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS m FROM g WINDOW w AS (PARTITION BY state ORDER BY block)),
    p AS (SELECT *, m >= quantile_cont(m, 0.75) OVER (PARTITION BY state) AS peak FROM f), r AS (SELECT *, block - row_number() OVER (PARTITION BY state, peak ORDER BY block) AS grp FROM p),
    u AS (SELECT state, grp, min(block) AS s, max(block) AS e, count(*) AS n FROM r WHERE peak GROUP BY state, grp), b AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY n DESC, s) AS rn FROM u)
    SELECT state, CASE WHEN n >= 3 THEN s ELSE 33 END AS peak_start, CASE WHEN n >= 3 THEN e ELSE 72 END AS peak_end FROM b WHERE rn = 1""")
def _(v):
    return cal.peak_window(v.load, min_width=3)
