"""Null-safe numeric helpers. Missing is NULL everywhere; NaN never leaves ingestion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterhour.functions.blocks import col


def to_number(c: Column | str) -> Column:
    """Cast to double; unreadable text, NaN and infinities become NULL."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clip(c: Column | str, lo: float | Column, hi: float | Column) -> Column:
    lo = F.lit(lo) if not isinstance(lo, Column) else lo
    hi = F.lit(hi) if not isinstance(hi, Column) else hi
    x = col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(col(a), col(b))


def pct_change(a: Column | str, b: Column | str) -> Column:
    """Change of a over b in percent, NULL when b is zero."""
    return F.try_divide(col(a) - col(b), col(b)) * 100.0


def finite_round(c: Column | str, digits: int = 2) -> Column:
    return F.round(to_number(c), digits)


def over_zero(c: Column | str, floor: float = 1.0) -> Column:
    """Placeholder hygiene: readings at or below ``floor`` are missing, not zero."""
    x = col(c)
    return F.when(x > floor, x)


def nonneg(c: Column | str) -> Column:
    """Floor at zero that keeps a missing value missing (greatest on its own would turn it into 0)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
