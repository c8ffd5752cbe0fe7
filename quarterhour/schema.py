"""Stored layouts and the registry of value columns."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, I, F8 = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


LOAD = _struct(("state", S), ("date", D), ("time_block", I), ("total_drawal", F8))
WEATHER_VALUES = ("temperature", "humidity", "precipitation", "cloud_cover", "cloud_cover_low", "sunshine_duration",
                  "direct_radiation", "wind_speed_10m")
WEATHER_MEAN = _struct(("state", S), ("date", D), ("time_block", I), *[(c, F8) for c in WEATHER_VALUES])
WEATHER_LOC = _struct(("state", S), ("location", S), ("date", D), ("time_block", I), *[(c, F8) for c in WEATHER_VALUES])
FORECAST = _struct(("state", S), ("date", D), ("block", I), ("forecast_mw", F8))
DISPATCH_FORECAST = _struct(("state", S), ("date", D), ("time_block", I), ("forecast_mw", F8))

# table -> (schema, name of the block column, value columns)
TABLES = {
    "load": (LOAD, "time_block", ("total_drawal",)),
    "sldc": (LOAD, "time_block", ("total_drawal",)),
    "weather_mean": (WEATHER_MEAN, "time_block", WEATHER_VALUES),
    "weather_loc": (WEATHER_LOC, "time_block", WEATHER_VALUES),
    "forecast": (FORECAST, "block", ("forecast_mw",)),
    "sldc_forecast": (DISPATCH_FORECAST, "time_block", ("forecast_mw",)),
}

# Analytics features and the aggregations allowed on them.
FEATURES = {
    "load": {"avg", "max", "min", "sum", "stddev_samp"},
    "temperature": {"avg", "max", "min", "stddev_samp"},
    "humidity": {"avg", "max", "min", "stddev_samp"},
    "precipitation": {"avg", "max", "sum"},
    "cloud_cover": {"avg", "max", "min"},
    "wind_speed_10m": {"avg", "max", "stddev_samp"},
    "direct_radiation": {"avg", "max", "sum"},
}


def check_feature(feature: str, aggregation: str | None = None) -> None:
    """Raise ValueError for a feature or aggregation outside the registry."""
    if feature not in FEATURES:
        raise ValueError(f"unknown feature {feature!r}; expected one of {sorted(FEATURES)}")
    if aggregation is not None and aggregation not in FEATURES[feature]:
        raise ValueError(f"aggregation {aggregation!r} is not defined for {feature!r}")
