"""The composed clean pipeline: repaired load, state weather beside it, gaps in the weather interpolated, calendar fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quarterhour.functions.blocks import block_index
from quarterhour.operators.calendar import with_calendar
from quarterhour.operators.clean import fix_spikes
from quarterhour.operators.grid import interpolate


def clean_frame(load: DataFrame, weather: DataFrame, holidays: DataFrame, columns: Sequence[str], spike: float = 500.0) -> DataFrame:
    """Load rows with their spikes repaired and the given weather columns of their state.

    ``weather`` has a row per (state, date, block). A block without weather takes the line between its neighbours in
    time, the ends the nearest reading, as every block of the load's own calendar counts. Calendar fields come last.
    """
    frame = fix_spikes(load, threshold=spike).join(weather.select("state", "date", "block", *columns), ["state", "date", "block"], "left")
    for c in columns:
        frame = interpolate(frame, c, ["state"], block_index("date", "block"))
    return with_calendar(frame, holidays)
