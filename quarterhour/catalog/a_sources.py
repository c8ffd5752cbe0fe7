"""2.A sources and sinks."""

import uuid

from pyspark.sql import functions as F

from quarterhour import dims
from quarterhour.catalog import views
from quarterhour.catalog.core import query
from quarterhour.catalog.sqlparts import interp, melt, spearman_wide
from quarterhour.functions.blocks import block_of, block_start, state_slug
from quarterhour.operators import reports
from quarterhour.plans.clean_frame import clean_frame
from quarterhour.plans.final_frame import FINAL_COLUMNS, final_frame
from quarterhour.sources import normalise, readers, sinks
from quarterhour.sources.layer import Layer, month_of
from quarterhour.sources.records import RecordStore
from quarterhour.sources.stage import shared, shared_folder


def stored(v):
    """Load in its stored layout."""
    return v.load.select("state", "date", F.col("block").alias("time_block"), F.col("load").alias("total_drawal"))


@query("a1_filtered_scan", "state date time_block:i total_drawal:f", """
    SELECT state, date, block AS time_block, load AS total_drawal FROM v_load
    WHERE state = 'ALL' AND date >= DATE '2024-01-05' AND date <= DATE '2024-01-12'""")
def _(v):
    return readers.scan(stored(v), "load", " all ", from_date="2024-01-05", to_date="2024-01-12")


@query("a1_scan_location", "state date time_block:i location temperature:f humidity:f", """
    SELECT state, date, block AS time_block, location, temperature, humidity FROM v_wloc
    WHERE state = 'R1' AND date = DATE '2024-01-09' AND location = 'D3' """)
def _(v):
    return readers.scan(v.wloc.withColumnRenamed("block", "time_block"), "weather_loc", "r1", date="2024-01-09", location="d3")


@query("a1_scan_limit", "state date time_block:i total_drawal:f", """
    SELECT state, date, block AS time_block, load AS total_drawal FROM v_load WHERE state = 'R0' ORDER BY date, block LIMIT 200""")
def _(v):
    return readers.scan(stored(v), "load", "R0", limit=200)


@query("a2_forecast_table", "state date time_block:i forecast_mw:f", """
    SELECT state, date, block AS time_block, forecast AS forecast_mw FROM v_fc WHERE state = 'R2' AND date >= DATE '2024-01-20'""")
def _(v):
    return readers.forecast_frame(v.fc.withColumnRenamed("forecast", "forecast_mw"), "R2", from_date="2024-01-20")


@query("a3_states", "state", "SELECT DISTINCT state FROM v_load")
def _(v):
    return readers.states(v.load)


@query("a3_locations", "location", "SELECT DISTINCT location FROM v_wloc WHERE state = 'R1'")
def _(v):
    return readers.locations(v.wloc, "R1")


@query("a4_coverage", "state first_date last_date dates:i rows:i", """
    SELECT state, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates, count(*) AS rows FROM v_load GROUP BY state""")
def _(v):
    return readers.coverage(v.load)


@query("a4_load_dates", "date", "SELECT DISTINCT date FROM v_load WHERE state = 'R0'")
def _(v):
    return readers.load_dates(v.load, "R0")


@query("a5_latest_days", "state date block:i load:f", """
    SELECT l.* FROM v_load l JOIN (SELECT state, max(date) AS m FROM v_load GROUP BY state) x USING (state) WHERE date > m - 7""")
def _(v):
    return readers.latest_days(v.load, 7)


@query("a6_reshape", "state date time_block:i forecasted:f", "SELECT state, date, block AS time_block, forecast AS forecasted FROM v_fc")
def _(v):
    return readers.reshape(v.fc, "forecast", "forecasted")


@query("a7_csv_rows", "state date time_block:i total_drawal:f Datetime", """
    SELECT state, date, block AS time_block, load AS total_drawal, CAST(date AS TIMESTAMP) + to_minutes((block - 1) * 15) AS "Datetime" FROM v_load""")
def _(v):
    line = F.concat_ws(",", "state", F.date_format("date", "yyyy-MM-dd"), F.col("block").cast("string"), F.col("load").cast("string"))
    rows = reports.parse_csv(v.load.select(line.alias("text")), "text", "state STRING, date DATE, time_block INT, total_drawal DOUBLE")
    return rows.withColumn("Datetime", block_start("date", "time_block"))


@query("a8_raw_demand", "state date block:i load:f", """
    SELECT state, date, block, avg(value) AS load FROM v_ev WHERE value > 0 GROUP BY ALL""")
def _(v):
    raw = v.ev.where("value > 0").select("state", "date", F.date_format("ts", "HH:mm").alias("time"),
                                         F.concat(F.lit("~ "), F.col("value").cast("decimal(12,2)").cast("string"), F.lit(" MW")).alias("demand"))
    return normalise.raw_demand(raw)


@query("a9_parquet_by_state", "event_id:i user_id:i value:f", """
    SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 100""")
def _(v):
    return v.table("events").where((F.col("event_type") == "error") & (F.col("value") > 100))


@query("a10_load_rows", "state date block:i load:f duplicates:i", """
    SELECT state, date, block, avg(value) AS load, count(*) - 1 AS duplicates FROM v_ev GROUP BY ALL""")
def _(v):
    feed = v.ev.select("state", F.col("date").cast("string").alias("date"), F.col("ts").alias("datetime"), F.col("value").cast("string").alias("load_mw"))
    return normalise.load_rows(feed)


_PLACES = ["gurgaon", "Hissar ", "sonepat", "KARNAL", "rohtak", "panipat", "yamuna_nagar"]
_PLACE_SQL = "[" + ", ".join(f"'{p}'" for p in _PLACES) + "][CAST(substr(location, 2) AS INTEGER) + 1]"
_CANON = {"gurgaon": "GURUGRAM", "Hissar ": "HISAR", "sonepat": "SONIPAT", "KARNAL": "KARNAL", "rohtak": "ROHTAK", "panipat": "PANIPAT",
          "yamuna_nagar": "YAMUNANAGAR"}
_CANON_SQL = "[" + ", ".join(f"'{_CANON[p]}'" for p in _PLACES) + "][CAST(substr(location, 2) AS INTEGER) + 1]"


def place_feed(v):
    """District weather under alias names and alias columns."""
    names = F.array(*[F.lit(p) for p in _PLACES])
    return v.wloc.select("state", "date", F.col("block").alias("time_block"),
                         F.element_at(names, F.substring("location", 2, 1).cast("int") + 1).alias("city"),
                         F.col("temperature").alias("temperature_2m"), F.col("humidity").alias("relative_humidity_2m"), F.col("precipitation").alias("rain"),
                         F.col("cloud_cover").alias("cloudcover"), F.col("wind_speed_10m").alias("windspeed_10m"))


@query("a11_weather_rows", "state date block:i district temperature:f humidity:f precipitation:f cloud_cover:f wind_speed_10m:f direct_radiation:f", f"""
    SELECT state, date, block, {_CANON_SQL} AS district, temperature, humidity, precipitation, cloud_cover, wind_speed_10m,
           CAST(NULL AS DOUBLE) AS direct_radiation FROM v_wloc""")
def _(v):
    return normalise.weather_rows(place_feed(v))


@query("a12_block_of_timestamp", "event_id:i block:i", "SELECT event_id, CAST(hour(ts) * 4 + floor(minute(ts) / 15.0) + 1 AS BIGINT) AS block FROM events")
def _(v):
    return v.table("events").select("event_id", block_of("ts").alias("block"))


@query("a13_state_slug", "n_name slug", """
    SELECT n_name, regexp_replace(upper(trim(' ' || n_name || '-north side ')), '[ -]', '_', 'g') AS slug FROM nation""")
def _(v):
    return v.table("nation").select("n_name", state_slug(F.concat(F.lit(" "), "n_name", F.lit("-north side "))).alias("slug"))


_MERGED = """
    m AS (SELECT state, date, block, s.load AS sldc, l.load AS aux FROM v_sldc s FULL OUTER JOIN v_load l USING (state, date, block)),
    z AS (SELECT *, block <= coalesce(max(CASE WHEN sldc IS NOT NULL THEN block END) OVER (PARTITION BY state, date), 0) AS in_zone FROM m),
    mg AS (SELECT state, date, block, CASE WHEN in_zone THEN coalesce(sldc, aux) ELSE coalesce(aux, sldc) END AS load FROM z)"""


@query("a14_final_frame", "state date time_block:i total_drawal:f Datetime temperature:f humidity:f precipitation:f cloud_cover:f cloud_cover_low:f "
       "sunshine_duration:f direct_radiation:f wind_speed_10m:f hour:i minute:i day_of_week:i day_of_month:i month:i is_weekend:i is_holiday:i "
       "hour_cos:f dow_sin:f dow_cos:f block_sin:f block_cos:f is_peak_hour:i is_night:i is_business_hour:i temp_squared:f temp_cubed:f temperature_sin:f", f"""
    WITH {_MERGED}, j AS (
      SELECT mg.state, strftime(mg.date, '%Y-%m-%d') AS date, block AS time_block, load AS total_drawal,
        CAST(mg.date AS TIMESTAMP) + to_minutes((block - 1) * 15) AS "Datetime", temperature, humidity, precipitation, cloud_cover,
        CAST(NULL AS DOUBLE) AS cloud_cover_low, CAST(NULL AS DOUBLE) AS sunshine_duration, direct_radiation, wind_speed_10m,
        isodow(mg.date) - 1 AS day_of_week, CAST(mg.date IN (SELECT holiday FROM v_hol) AS INTEGER) AS is_holiday
      FROM mg LEFT JOIN v_wmean w USING (state, date, block) WHERE mg.date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21'),
    h AS (SELECT *, hour("Datetime") AS hour, minute("Datetime") AS minute, day("Datetime") AS day_of_month, month("Datetime") AS month,
            CAST(day_of_week >= 5 AS INTEGER) AS is_weekend FROM j)
    SELECT *, cos(2 * pi() * hour / 24) AS hour_cos, sin(2 * pi() * day_of_week / 7) AS dow_sin, cos(2 * pi() * day_of_week / 7) AS dow_cos,
      sin(2 * pi() * time_block / 96) AS block_sin, cos(2 * pi() * time_block / 96) AS block_cos,
      CAST((hour >= 6 AND hour < 10) OR (hour >= 18 AND hour < 22) AS INTEGER) AS is_peak_hour, CAST(hour >= 22 OR hour < 6 AS INTEGER) AS is_night,
      CAST(hour >= 9 AND hour < 18 AND is_weekend = 0 AS INTEGER) AS is_business_hour, temperature ** 2 AS temp_squared, temperature ** 3 AS temp_cubed,
      sin(2 * pi() * temperature / 40) AS temperature_sin FROM h""")
def _(v):
    return final_frame(v.sldc, v.load, v.wmean, v.hol, from_date="2024-01-08", to_date="2024-01-21").select("state", *FINAL_COLUMNS)


_CLEAN = f"""n AS (SELECT *, abs(load - lag(load) OVER w) AS l, abs(lead(load) OVER w - load) AS r, row_number() OVER w AS pos, lag(1) OVER w IS NULL AS f, lead(1) OVER w IS NULL AS z FROM v_load WINDOW w AS (PARTITION BY state, date ORDER BY block)),
    s AS (SELECT state, date, block, pos, CASE WHEN NOT coalesce(CASE WHEN f AND z THEN false WHEN f THEN r > 150 WHEN z THEN l > 150 ELSE (l + r) / 2 > 150 END, false) THEN load END AS v FROM n),
    c AS (SELECT state, date, block, filled AS load, CAST(date - DATE '1970-01-01' AS BIGINT) * 96 + block AS t FROM ({interp('s', 'state, date', 'pos', 'v')})),
    j AS (SELECT c.*, temperature, humidity FROM c LEFT JOIN v_wmean USING (state, date, block)),
    a AS (SELECT * EXCLUDE (temperature, pp, np, pv, nv, filled), filled AS temperature FROM ({interp('j', 'state', 't', 'temperature')})),
    b AS (SELECT * EXCLUDE (humidity, pp, np, pv, nv, filled), filled AS humidity FROM ({interp('a', 'state', 't', 'humidity')}))"""


@query("a15_clean_pipeline", "state date block:i load:f temperature:f humidity:f dow:i is_weekend:i is_holiday:i hour:i month:i", f"""
    WITH {_CLEAN} SELECT state, date, block, load, temperature, humidity, isodow(date) - 1 AS dow, CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
      CAST(date IN (SELECT holiday FROM v_hol) AS INTEGER) AS is_holiday, (block - 1) // 4 AS hour, month(date) AS month FROM b""")
def _(v):
    return clean_frame(v.load, v.wmean, v.hol, ["temperature", "humidity"], spike=150.0)


@query("a16_csv_sink", "state date block:i load:f", "SELECT * FROM v_load")
def _(v):
    path = f"{shared_folder(v.spark)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(v.load, path)
    return readers.read_frame_csv(v.spark, path, "state STRING, date DATE, block INT, load DOUBLE, Datetime TIMESTAMP_NTZ")


@query("a17_parquet_store", "state month days:i load:f", "SELECT state, strftime(date, '%Y-%m') AS month, count(DISTINCT date) AS days, sum(load) AS load FROM v_load GROUP BY ALL")
def _(v):
    path = f"{shared_folder(v.spark)}/blocks-{uuid.uuid4().hex}"
    sinks.write_by_month(v.load, path)
    stored = v.spark.read.parquet(path)
    return stored.groupBy("state", "month").agg(F.count_distinct("date").alias("days"), F.sum("load").alias("load"))


def _load_layer(v, name):
    return Layer(v.spark, f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}", views.LAYER_KEYS, views.LAYER_SUMS, ("value_max",), {"blocks": views.block_rows})


@query("a17_ttl_read", "state month days:i load:f", """
    SELECT state, strftime(date, '%Y-%m') AS month, count(DISTINCT date) AS days, sum(load) AS load FROM v_load
    WHERE state <> 'R0' OR date <= DATE '2024-01-20' GROUP BY ALL""")
def _(v):
    """A store whose parts differ in age: all were written at 1000, R0 again at 5000; a read at 5900 lets parts live 900 seconds."""
    events, cut = v.table("events"), F.lit("2024-01-20").cast("date")
    layer = _load_layer(v, "ttl")
    layer.replace(views.layer_rows(events.where(F.to_date("ts") <= cut)).where("state <> 'R1'"), written_at=1000.0)
    layer.replace(views.layer_rows(events.where(F.to_date("ts") <= cut)).where("state = 'R0'"), written_at=5000.0)

    def fetch(parts):
        names = [f"{s}/{m}" for s, m in parts]
        return views.layer_rows(events).where(F.concat_ws("/", "state", month_of()).isin(names))

    everything = {(s, "2024-01") for s in ("ALL", "R0", "R1", "R2")}  # R1 is not stored yet
    fresh = layer.read_fresh("blocks", 900.0, fetch, now=5900.0, wanted=everything)
    return fresh.withColumn("month", month_of()).groupBy("state", "month").agg(F.count_distinct("date").alias("days"), F.sum("load").alias("load"))


@query("a17_late_events", "state date block:i load:f", "SELECT * FROM v_load")
def _(v):
    """Events arrive in two files, the second with late ones; the layer takes up each file once."""
    folder = f"{shared_folder(v.spark)}/late-{uuid.uuid4().hex}"
    events, layer = v.table("events"), _load_layer(v, "late-layer")
    late = (F.col("event_type") == "view") | (F.to_date("ts") > F.lit("2024-01-20").cast("date"))
    for part in (events.where(~late), events.where(late)):
        part.write.mode("append").parquet(folder)
        layer.refresh(folder, views.layer_rows)
    layer.refresh(folder, views.layer_rows)  # nothing new
    return layer.read("blocks")


@query("a18_record_id", "state date record_id", """
    SELECT state, date, substr(sha256(state || '|' || CAST(date AS VARCHAR) || '|1|naive|' || CAST(CAST(round(sum(load) * 100) AS BIGINT) AS VARCHAR)), 1, 12) AS record_id
    FROM v_load GROUP BY state, date""")
def _(v):
    d = v.load.groupBy("state", "date").agg(F.round(F.sum("load") * 100).cast("bigint").alias("total"))
    return d.select("state", "date", sinks.record_id("state", "date", F.lit("1"), F.lit("naive"), "total").alias("record_id"))


@query("a18_pruned_append", "state date record_id", """
    SELECT state, date, substr(sha256(state || '|' || CAST(date AS VARCHAR) || '|1|naive|' || CAST(CAST(round(sum(load) * 100) AS BIGINT) AS VARCHAR)), 1, 12) AS record_id
    FROM v_load GROUP BY state, date""")
def _(v):
    """Records come in three appends: one region, all regions (which repeats the first), and all again."""
    d = v.load.groupBy("state", "date").agg(F.round(F.sum("load") * 100).cast("bigint").alias("total"))
    records = shared(d.select("state", "date", sinks.record_id("state", "date", F.lit("1"), F.lit("naive"), "total").alias("record_id")))
    store = RecordStore(v.spark, f"{shared_folder(v.spark)}/records-{uuid.uuid4().hex}")
    for part in (records.where("state = 'R0'"), records, records):
        store.append(part)
    return store.read()


@query("a19_top_up", "state date block:i load:f", """
    WITH last AS (SELECT state, max(date) AS d FROM v_sldc GROUP BY state)
    SELECT l.* FROM v_load l LEFT JOIN last USING (state) WHERE (d IS NULL OR l.date >= d)
      AND NOT EXISTS (SELECT 1 FROM v_sldc s WHERE s.state = l.state AND s.date = l.date AND s.block = l.block)""")
def _(v):
    return sinks.top_up(v.load, v.sldc, ["state", "date", "block"])


@query("a20_schedule_export", "state date Block:i Time Schedule_MW:f Baseline_MW:f energy_mwh:f peak_mw:f", """
    SELECT state, date, block AS "Block", printf('%02d:%02d', (block - 1) // 4, ((block - 1) % 4) * 15) AS "Time", forecast AS "Schedule_MW", actual AS "Baseline_MW",
      sum(forecast) OVER (PARTITION BY state, date) * 0.25::DOUBLE AS energy_mwh, max(forecast) OVER (PARTITION BY state, date) AS peak_mw FROM v_pair""")
def _(v):
    return sinks.schedule_export(v.pair, "forecast", "actual")


_REPORT = ["records", "days", "average", "peak", "minimum", "std", "cv_pct", "trend_start", "trend_end", "trend_pct", "weekday_avg", "weekend_avg",
           "weekend_effect_pct", "temperature_corr", "outliers", "outlier_rate_pct"]


@query("a21_report_summary", "state section metric value:f", f"""
    WITH b AS (SELECT state, count(*) AS records, max(date) - min(date) AS days, avg(load) AS average, max(load) AS peak, min(load) AS minimum,
        stddev_samp(load) AS std, stddev_pop(load) AS sp, avg(load) FILTER (WHERE is_weekend = 0) AS weekday_avg,
        avg(load) FILTER (WHERE is_weekend = 1) AS weekend_avg FROM v_frame GROUP BY state),
    d AS (SELECT state, date, avg(load) AS v, row_number() OVER (PARTITION BY state ORDER BY date) AS u,
        row_number() OVER (PARTITION BY state ORDER BY date DESC) AS dn FROM v_frame GROUP BY state, date),
    t AS (SELECT state, avg(v) FILTER (WHERE u <= 7) AS trend_start, avg(v) FILTER (WHERE dn <= 7) AS trend_end FROM d GROUP BY state),
    z AS (SELECT f.state, count(*) FILTER (WHERE abs(load - average) > 3 * sp) AS outliers, count(load) AS n FROM v_frame f JOIN b USING (state) GROUP BY f.state),
    r AS ({spearman_wide('v_frame', 'state', {'temperature_corr': ('load', 'temperature')})}),
    j AS (SELECT b.*, trend_start, trend_end, (trend_end - trend_start) / trend_start * 100 AS trend_pct, (weekend_avg - weekday_avg) / weekday_avg * 100 AS weekend_effect_pct,
        std / average * 100 AS cv_pct, temperature_corr, outliers, outliers * 100.0::DOUBLE / n AS outlier_rate_pct FROM b JOIN t USING (state) JOIN z USING (state) JOIN r USING (state))
    SELECT *, 'report' AS section FROM ({melt('j', 'state', _REPORT)})""")
def _(v):
    return reports.unpivot(reports.report_summary(v.frame), ["state"], "report")


@query("a22_month_year_extract", "state date load:f", "SELECT * FROM v_daily WHERE month(date) IN (5, 6) AND year(date) BETWEEN 1996 AND 1999")
def _(v):
    return readers.month_year_extract(v.daily, (5, 6), (1996, 1999))


@query("a23_revisions", "state date block:i model revision:i", """
    SELECT state, date, block, model, row_number() OVER (PARTITION BY state, date, block ORDER BY model) - 1 AS revision FROM v_fcm""")
def _(v):
    return sinks.with_revision(v.fcm, ["state", "date", "block"], ["model"])


@query("a25_data_summary", "state section metric value:f", """
    WITH b AS (SELECT state, count(*) AS total_rows, count(DISTINCT date) AS total_days, avg(load) AS mean_mw, max(load) AS peak_mw, min(load) AS min_mw FROM v_cal GROUP BY state)
    SELECT state, 'data_summary' AS section, metric, value FROM (""" + melt("b", "state", ["total_rows", "total_days", "mean_mw", "peak_mw", "min_mw"]) + """)
    UNION ALL SELECT state, 'avg_by_dow', CAST(dow AS VARCHAR), avg(load) FROM v_cal GROUP BY state, dow
    UNION ALL SELECT state, 'avg_by_hour', CAST(hour AS VARCHAR), avg(load) FROM v_cal GROUP BY state, hour""")
def _(v):
    return reports.data_summary(v.cal)


@query("a11_district_shares", "district circle share_pct:f", "SELECT * FROM (VALUES " + ", ".join(
    f"('{ {c: d for d, c in dims.CIRCLE_OF_DISTRICT.items()}.get(c, c) }', '{c}', {w}::DOUBLE)" for c, w in dims.CIRCLE_SHARE_PCT.items())
    + ") t(district, circle, share_pct) WHERE district IN (SELECT " + _CANON_SQL + " FROM v_wloc)")
def _(v):
    feed = place_feed(v).select("city").distinct().select(normalise.canonical_district("city").alias("district"))
    return dims.canonical_weights(v.spark).join(feed, "district", "left_semi")
