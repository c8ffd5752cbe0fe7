"""Thermal-comfort expressions. A missing input gives a missing output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarterhour.functions.blocks import col

# Stull (2011) coefficients and validity range, Magnus coefficients (Alduchov & Eskridge 1996).
STULL = (0.151977, 8.313659, 1.676331, 0.00391838, 1.5, 0.023101, 4.686035)
STULL_RH = (5.0, 99.0)
STULL_T = (-20.0, 50.0)
MAGNUS_A, MAGNUS_B = 17.625, 243.04


def wet_bulb(t: Column | str, rh: Column | str) -> Column:
    """Stull wet-bulb temperature, NULL outside its validity range."""
    t, rh = col(t), col(rh)
    a, b, c, d, e, f, g = STULL
    tw = (t * F.atan(a * F.sqrt(rh + b)) + F.atan(t + rh) - F.atan(rh - c) + d * F.pow(rh, F.lit(e)) * F.atan(f * rh) - g)
    return F.when(rh.between(*STULL_RH) & t.between(*STULL_T), tw)


def dew_point(t: Column | str, rh: Column | str) -> Column:
    """Magnus dew point, NULL for non-positive humidity."""
    t, rh = col(t), col(rh)
    g = F.ln(F.least(rh, F.lit(100.0)) / 100.0) + MAGNUS_A * t / (MAGNUS_B + t)
    return F.when((rh > 0) & t.isNotNull(), MAGNUS_B * g / (MAGNUS_A - g))


def degrees_above(t: Column | str, base: float) -> Column:
    t = col(t)
    return F.when(t.isNotNull(), F.greatest(t - base, F.lit(0.0)))


def degrees_below(t: Column | str, base: float) -> Column:
    t = col(t)
    return F.when(t.isNotNull(), F.greatest(base - t, F.lit(0.0)))
