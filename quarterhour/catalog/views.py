"""Fixture views: the supplied tables read as demand, weather and forecast series.

``Views`` builds them as DataFrames, ``CTES`` states the same definitions in SQL for the twins. Regions are
``R0..R2`` (user id modulo 3) and ``ALL`` (everything), so one region always holds half of the rows. The raw events
are aggregated once, with map-side partial sums, into a stored layer of (state, date, block) that all load and weather views read.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.functions.blocks import block_of
from quarterhour.operators.calendar import with_calendar
from quarterhour.operators.features import eda_frame, series_frame, with_baseline
from quarterhour.operators.grid import day_lag, dense_grid
from quarterhour.sources.layer import Layer
from quarterhour.sources.stage import shared, shared_folder

DISTRICT_WEIGHTS = {f"D{i}": 7.0 - i for i in range(7)}
#: Holidays of the fixture besides the national days: an input of the queries, not of the library.
FIXTURE_HOLIDAYS = ("2024-01-01", "2024-01-15")
_DAYS = ", ".join(f"({m}, {d})" for m, d in dims.NATIONAL_DAYS)
_EXTRA = ", ".join(f"(DATE '{d}')" for d in FIXTURE_HOLIDAYS)
_W = "temperature humidity precipitation cloud_cover wind_speed_10m direct_radiation".split()

CTES = {
    "v_ev": """
        SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS date,
               CAST(hour(ts) * 4 + floor(minute(ts) / 15.0) + 1 AS INTEGER) AS block,
               try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, s.state
        FROM events CROSS JOIN LATERAL (SELECT unnest(['ALL', 'R' || CAST(user_id % 3 AS VARCHAR)]) AS state) s""",
    "v_load": "SELECT state, date, block, round(sum(value), 4) AS load FROM v_ev GROUP BY ALL",
    "v_sldc": "SELECT state, date, block, round(sum(value), 4) AS load FROM v_ev WHERE event_type IN ('click','view','purchase') GROUP BY ALL",
    "v_wloc": """
        SELECT state, 'D' || CAST(user_id % 7 AS VARCHAR) AS location, date, block,
               round(10 + 0.35::DOUBLE * avg(k) + 1e-9, 6) AS temperature, round(20 + 0.5::DOUBLE * avg(100 - k) + 0.1::DOUBLE * least(avg(value), 200) + 1e-9, 6) AS humidity,
               round(greatest(0.0::DOUBLE, max(value) - 150) / 10 + 1e-9, 6) AS precipitation, round(avg(k) + 1e-9, 6) AS cloud_cover,
               round(avg(value) / 4 + 1e-9, 6) AS wind_speed_10m,
               round(greatest(0.0::DOUBLE, 600 * sin(pi() * ((block - 1) / 4.0::DOUBLE - 6) / 12)) + 1e-9, 6) AS direct_radiation
        FROM v_ev GROUP BY ALL""",
    "v_wmean": "SELECT state, date, block, " + ", ".join(f"round(avg({c}) + 1e-9, 6) AS {c}" for c in _W) + " FROM v_wloc GROUP BY ALL",
    "v_dw": "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {w}::DOUBLE)" for d, w in DISTRICT_WEIGHTS.items()) + ") t(location, weight)",
    "v_hol": f"""
        SELECT make_date(CAST(y AS INTEGER), m, d) AS holiday FROM (SELECT unnest(range({dims.YEARS[0]}, {dims.YEARS[1]})) AS y), (VALUES {_DAYS}) n(m, d)
        UNION SELECT * FROM (VALUES {_EXTRA}) t(holiday)""",
    "v_daily": """
        SELECT r.r_name AS state, CAST(o.o_orderdate AS DATE) AS date, round(sum(o.o_totalprice) / 1000 + 1e-9, 6) AS load
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL""",
    "v_grid": """
        SELECT g.state, g.date, g.block, l.load FROM
        (SELECT state, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date, b.block
         FROM v_load CROSS JOIN (SELECT CAST(unnest(range(1, 97)) AS INTEGER) AS block) b GROUP BY state, b.block) g
        LEFT JOIN v_load l USING (state, date, block)""",
    "v_cal": """
        SELECT l.*, CAST(isodow(date) - 1 AS INTEGER) AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
               CAST(date IN (SELECT holiday FROM v_hol) AS INTEGER) AS is_holiday, CAST((block - 1) // 4 AS INTEGER) AS hour,
               CAST(month(date) AS INTEGER) AS month
        FROM v_load l""",
    "v_frame": "SELECT c.*, " + ", ".join(f"w.{c}" for c in _W) + " FROM v_cal c LEFT JOIN v_wmean w USING (state, date, block)",
    "v_t": "SELECT *, CAST(date - DATE '1970-01-01' AS BIGINT) AS dn, CAST(date - DATE '1970-01-01' AS BIGINT) * 96 + block AS t FROM v_frame",
    "v_base": """
        SELECT *, avg(load) OVER w AS baseline, avg(temperature) OVER w AS n_temp, avg(humidity) OVER w AS n_hum, avg(precipitation) OVER w AS n_rain
        FROM v_t WINDOW w AS (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
    "v_hd": """
        SELECT d.date, CAST(max(h.holiday = d.date + 1) AS INTEGER) AS hn, CAST(max(h.holiday = d.date - 1) AS INTEGER) AS hp,
               coalesce(min(h.holiday - d.date) FILTER (WHERE h.holiday >= d.date), 999) AS days_to_holiday,
               coalesce(min(d.date - h.holiday) FILTER (WHERE h.holiday <= d.date), 999) AS days_since_holiday
        FROM (SELECT DISTINCT date FROM v_load) d CROSS JOIN v_hol h GROUP BY d.date""",
    "v_eda1": """
        SELECT v_t.*, days_to_holiday, days_since_holiday,
          CASE WHEN month IN (12,1,2) THEN 'Winter' WHEN month IN (3,4,5) THEN 'Spring' WHEN month IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season,
          CASE WHEN hour <= 6 THEN 'Night' WHEN hour <= 12 THEN 'Morning' WHEN hour <= 18 THEN 'Afternoon' ELSE 'Evening' END AS time_of_day,
          CAST(dow = 0 AS INTEGER) AS is_monday, CAST(dow = 4 AS INTEGER) AS is_friday,
          sin(2 * pi() * (block - 1) / 96) AS block_sin, cos(2 * pi() * (block - 1) / 96) AS block_cos,
          sin(2 * pi() * hour / 24) AS hour_sin, cos(2 * pi() * hour / 24) AS hour_cos,
          CAST(hour BETWEEN 7 AND 10 AS INTEGER) AS is_morning_peak, CAST(hour BETWEEN 18 AND 22 AS INTEGER) AS is_evening_peak,
          CAST(hour BETWEEN 1 AND 5 AS INTEGER) AS is_night_valley,
          CAST(is_holiday = 1 AND dow = 4 AS INTEGER) AS holiday_before_weekend, CAST(is_holiday = 1 AND dow = 0 AS INTEGER) AS holiday_after_weekend,
          CAST(is_holiday = 0 AND dow < 5 AND (hn = 1 OR hp = 1) AS INTEGER) AS bridge_day, CAST(dow >= 5 AND (hn = 1 OR hp = 1) AS INTEGER) AS long_weekend,
          CASE WHEN temperature IS NOT NULL THEN greatest(temperature - 24, 0) END AS cooling_degree,
          0.5::DOUBLE * (temperature + 61 + (temperature - 68) * 1.2::DOUBLE + humidity * 0.094::DOUBLE) AS heat_index,
          CAST(precipitation > 0.1 AS INTEGER) AS rain_proxy,
          CASE WHEN precipitation <= 0.01 THEN 'None' WHEN precipitation <= 1 THEN 'Light' WHEN precipitation <= 5 THEN 'Moderate'
               WHEN precipitation <= 20 THEN 'Heavy' WHEN precipitation <= 1000 THEN 'Storm' END AS rain_intensity,
          CAST(precipitation > 5 AS INTEGER) AS is_heavy_rain,
          max(load) OVER (sb RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS d1, max(load) OVER (sb RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS d2,
          max(load) OVER (sb RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS d7,
          max(temperature) OVER (sb RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS temp_d1,
          max(temperature) OVER (sb RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS temp_d7,
          avg(load) OVER (sb RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS roll7_block,
          avg(load) OVER (PARTITION BY state, block) AS block_mean, stddev_samp(load) OVER (PARTITION BY state, block) AS block_std,
          max(load) OVER (st RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS prev, avg(temperature) OVER (st RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS temp_roll_3h,
          avg(temperature) OVER (st RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS temp_roll_6h,
          avg(load) OVER (st RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS load_last_24,
          avg(temperature) OVER (st RANGE BETWEEN 671 PRECEDING AND CURRENT ROW) AS temp_roll_7d,
          avg(humidity) OVER (st RANGE BETWEEN 671 PRECEDING AND CURRENT ROW) AS hum_roll_7d,
          stddev_samp(load) OVER (st RANGE BETWEEN 671 PRECEDING AND CURRENT ROW) AS load_roll_7d_std
        FROM v_t JOIN v_hd USING (date)
        WINDOW sb AS (PARTITION BY state, block ORDER BY dn), st AS (PARTITION BY state ORDER BY t)""",
    "v_eda2": """
        SELECT *, roll7_block - max(roll7_block) OVER (PARTITION BY state, block ORDER BY dn RANGE BETWEEN 7 PRECEDING AND 7 PRECEDING) AS roll7_trend,
          load - prev AS ramp, load - d1 AS dod_change, load - d7 AS wow_change, temperature * is_evening_peak AS temp_x_peak,
          temperature * load AS weather_x_load, block * d1 AS block_x_d1, load * is_weekend AS weekend_load, load * is_holiday AS holiday_load,
          load - block_mean AS baseline_dev, abs(load - block_mean) / (block_std + 1e-6) AS dev_score,
          avg(load) OVER (PARTITION BY state, season) AS seasonal_profile, avg(load) OVER (PARTITION BY state, dow) AS weekly_profile
        FROM v_eda1""",
    "v_eda": """
        SELECT e.*, (block_std - bm) / (bs + 1e-6) AS variance_score, CASE WHEN dev_score > q THEN 1 ELSE 0 END AS peak_volatility
        FROM v_eda2 e JOIN (SELECT state, avg(block_std) AS bm, stddev_samp(block_std) AS bs, quantile_cont(dev_score, 0.95) AS q FROM v_eda2 GROUP BY state) USING (state)""",
    "v_fc": """
        SELECT state, CAST(date + 7 AS DATE) AS date, block, load AS forecast FROM v_load""",
    "v_fcm": """
        SELECT 'lag7' AS model, state, date, block, forecast FROM v_fc
        UNION ALL
        SELECT 'lag1', state, CAST(date + 1 AS DATE), block, load FROM v_load""",
    "v_pair": """
        SELECT l.state, l.date, l.block, l.load AS actual, f.forecast FROM v_load l JOIN v_fc f USING (state, date, block)""",
}


def _six(c: Column) -> Column:
    """Six places: means of doubles depend on row order in the last bits, and ties in rankings must be real ties."""
    return F.round(c + 1e-9, 6)


def event_rows(events: DataFrame) -> DataFrame:
    """Events with block, json field k and the regions they count for."""
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", F.to_date("ts").alias("date"), block_of("ts").alias("block"),
        F.get_json_object("props", "$.k").try_cast("double").alias("k"),
        F.explode(F.array(F.lit("ALL"), F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string")))).alias("state"))


LAYER_KEYS = ("state", "date", "block", "location", "in_feed")
LAYER_SUMS = ("value_sum", "value_n", "k_sum", "k_n")


def layer_rows(events: DataFrame) -> DataFrame:
    """What an event adds to the sums of its region, block and location."""
    known = lambda c: F.col(c).isNotNull().cast("long")
    return event_rows(events).select(
        "state", "date", "block", F.concat(F.lit("D"), (F.col("user_id") % 7).cast("string")).alias("location"), F.col("event_type").isin("click", "view", "purchase").alias("in_feed"),
        F.col("value").alias("value_sum"), known("value").alias("value_n"), F.col("k").alias("k_sum"), known("k").alias("k_n"), F.col("value").alias("value_max"))


def block_rows(partials: DataFrame) -> DataFrame:
    """One row per region and block: load, the feed's load, mean weather, and the weather of each location."""
    sun = 600.0 * F.sin(F.pi() * ((F.col("block") - 1) / 4.0 - 6.0) / 12.0)
    k, value = F.col("k_sum") / F.col("k_n"), F.col("value_sum") / F.col("value_n")
    a = partials.groupBy("state", "location", "date", "block").agg(
        *[F.sum(c).alias(c) for c in LAYER_SUMS], F.max("value_max").alias("mx"), F.sum(F.when(F.col("in_feed"), F.col("value_sum"))).alias("feed_sum"))
    at = a.select(
        "state", "location", "date", "block", "value_sum", "feed_sum", _six(10.0 + 0.35 * k).alias("temperature"),
        _six(20.0 + 0.5 * ((100.0 * F.col("k_n") - F.col("k_sum")) / F.col("k_n")) + 0.1 * F.least(value, F.lit(200.0))).alias("humidity"), _six(F.greatest(F.lit(0.0), F.col("mx") - 150.0) / 10.0).alias("precipitation"),
        _six(k).alias("cloud_cover"), _six(value / 4.0).alias("wind_speed_10m"), _six(F.greatest(F.lit(0.0), sun)).alias("direct_radiation"))
    return at.groupBy("state", "date", "block").agg(
        F.round(F.sum("value_sum"), 4).alias("load"), F.round(F.sum("feed_sum"), 4).alias("feed_load"), *[_six(F.avg(c)).alias(c) for c in _W], F.array_sort(F.collect_list(F.struct("location", *_W))).alias("locations"))


class Views:
    """The fixture views over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def ev(self) -> DataFrame:
        """Events with block, json field k and the regions they count for."""
        return event_rows(self.table("events"))

    @cached_property
    def blocks(self) -> DataFrame:
        """The stored layer's rows of (state, date, block). All queries of one application share it; new event files are added."""
        own = hashlib.sha256(self.dir.encode()).hexdigest()[:16]
        path = f"{shared_folder(self.spark)}/layer-{self.spark.sparkContext.applicationId}-{own}"
        layer = Layer(self.spark, path, LAYER_KEYS, LAYER_SUMS, ("value_max",), {"blocks": block_rows})
        layer.refresh(f"{self.dir}/events.parquet", layer_rows)
        return layer.read("blocks")

    @cached_property
    def load(self) -> DataFrame:
        return self.blocks.select("state", "date", "block", "load")

    @cached_property
    def sldc(self) -> DataFrame:
        return self.blocks.where(F.col("feed_load").isNotNull()).select("state", "date", "block", F.col("feed_load").alias("load"))

    @cached_property
    def wloc(self) -> DataFrame:
        return self.blocks.select("state", "date", "block", F.inline("locations")).select("state", "location", "date", "block", *_W)

    @cached_property
    def wmean(self) -> DataFrame:
        return self.blocks.select("state", "date", "block", *_W)

    @cached_property
    def dw(self) -> DataFrame:
        rows = ", ".join(f"('{d}', CAST({w} AS DOUBLE))" for d, w in DISTRICT_WEIGHTS.items())
        return dims.values_frame(self.spark, "location, weight", rows)

    @cached_property
    def hol(self) -> DataFrame:
        return dims.holidays(self.spark, FIXTURE_HOLIDAYS)

    @cached_property
    def daily(self) -> DataFrame:
        o = self.table("orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        n = self.table("nation").select("n_nationkey", "n_regionkey")
        r = self.table("region").select("r_regionkey", F.col("r_name").alias("state"))
        j = (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
        return j.groupBy("state", "date").agg(_six(F.sum("o_totalprice") / 1000.0).alias("load"))

    @cached_property
    def grid(self) -> DataFrame:
        """Load on every block between the first and the last date of the region."""
        return dense_grid(self.load)

    @cached_property
    def cal(self) -> DataFrame:
        return with_calendar(self.load, self.hol)

    @cached_property
    def frame(self) -> DataFrame:
        rows = with_calendar(self.blocks.select("state", "date", "block", "load", *_W), self.hol)
        return rows.select(*[c for c in rows.columns if c not in _W], *_W)

    @cached_property
    def base(self) -> DataFrame:
        """Frame with the mean of the seven days before as baseline of load and weather."""
        return with_baseline(self.frame)

    @cached_property
    def eda(self) -> DataFrame:
        """The exploration frame with lags, rolling terms and baselines."""
        return eda_frame(self.frame, self.hol)

    @cached_property
    def ser_lazy(self) -> DataFrame:
        """The series frame for tables that read it once or twice."""
        return series_frame(self.frame)

    @cached_property
    def ser(self) -> DataFrame:
        """The lean series frame of the KPI tables, stored once because those tables read it several times."""
        return shared(self.ser_lazy)

    @cached_property
    def frame_once(self) -> DataFrame:
        """The frame stored once, for tables that read it several times."""
        return shared(self.frame)

    @cached_property
    def fc(self) -> DataFrame:
        """A stored external forecast: the load of seven days before."""
        return self._shifted(7)

    def _shifted(self, k: int) -> DataFrame:
        return self.load.select("state", F.date_add("date", k).alias("date"), "block", F.col("load").alias("forecast"))

    @cached_property
    def fcm(self) -> DataFrame:
        """Two stored models: lag 7 and lag 1."""
        return (self.fc.withColumn("model", F.lit("lag7"))
                .unionByName(self._shifted(1).withColumn("model", F.lit("lag1"))))

    @cached_property
    def pair(self) -> DataFrame:
        """Actual and stored forecast, side by side."""
        lag = self.load.withColumn("forecast", day_lag("load", 7))
        return lag.where(F.col("forecast").isNotNull()).withColumnRenamed("load", "actual")
