"""Column expressions for the 96 quarter-hour blocks of a day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterhour import BLOCKS_PER_DAY


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def block_of(ts: Column | str) -> Column:
    """Block 1..96 that contains a timestamp; block b covers minutes (b-1)*15 .. b*15."""
    ts = col(ts)
    return (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15) + 1).cast("int")


def block_start(date: Column | str, block: Column | str) -> Column:
    """Timestamp at which a block starts."""
    return add_minutes(col(date).cast("timestamp_ntz"), (col(block) - 1) * 15)


def add_minutes(ts: Column | str, minutes: Column) -> Column:
    return col(ts) + F.make_dt_interval(mins=minutes.cast("int"))


def block_label(block: Column | str) -> Column:
    """HH:MM at which a block starts."""
    b = col(block) - 1
    return F.format_string("%02d:%02d", F.floor(b / 4).cast("int"), ((b % 4) * 15).cast("int"))


def hour_of(block: Column | str) -> Column:
    return F.floor((col(block) - 1) / 4).cast("int")


def day_number(date: Column | str) -> Column:
    """Integer day count; range frames over it address "k days ago" without a dense grid."""
    return F.datediff(col(date), F.lit("1970-01-01").cast("date"))


def block_index(date: Column | str, block: Column | str) -> Column:
    """Absolute quarter-hour number, so that neighbours in time differ by one across midnight."""
    return day_number(date).cast("bigint") * BLOCKS_PER_DAY + col(block)


def state_slug(name: Column | str) -> Column:
    return F.regexp_replace(F.upper(F.trim(col(name))), "[ -]", "_")


def parse_hhmm(text: Column | str) -> Column:
    """Block number of an HH:MM label (null when unreadable)."""
    parts = F.split(col(text), ":")
    h, m = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return (h * 4 + F.floor(m / 15) + 1).cast("int")


def weekday(date: Column | str) -> Column:
    """Monday = 0."""
    return F.weekday(col(date))


def is_weekend(date: Column | str) -> Column:
    return (F.weekday(col(date)) >= 5).cast("int")


def season(month: Column) -> Column:
    """Four-season map by month number."""
    return (F.when(month.isin(12, 1, 2), "Winter").when(month.isin(3, 4, 5), "Summer")
            .when(month.isin(6, 7, 8, 9), "Monsoon").otherwise("Post-Monsoon"))


def rotated(date: Column | str, block: Column | str, start_block: int = 33) -> tuple[Column, Column]:
    """Forecast day that begins at ``start_block`` instead of midnight: (rot_date, rot_block)."""
    b = col(block)
    rot_date = F.date_sub(col(date), F.when(b < start_block, 1).otherwise(0))
    return rot_date, (F.pmod(b - start_block, F.lit(BLOCKS_PER_DAY)) + 1).cast("int")


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    import math
    angle = value * (2.0 * math.pi) / period
    return F.sin(angle), F.cos(angle)
