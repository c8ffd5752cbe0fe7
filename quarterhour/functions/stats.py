"""Aggregate expressions and rank statistics shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import col


def avg_where(cond: Column, value: Column | str) -> Column:
    return F.avg(F.when(cond, col(value)))


def sum_where(cond: Column, value: Column | str) -> Column:
    return F.sum(F.when(cond, col(value)))


def share_where(cond: Column) -> Column:
    """Share of rows for which the condition holds."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def weighted_avg(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean renormalised over the rows that carry a value."""
    v, w = col(value), col(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation that is NULL, not an error, for constant input."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def slope(y: Column | str, x: Column | str) -> Column:
    """Least-squares slope of y on x; NULL when x is constant."""
    y, x = col(y), col(x)
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(y, x), F.var_pop(F.when(both, x)))


def intercept(y: Column | str, x: Column | str) -> Column:
    y, x = col(y), col(x)
    both = x.isNotNull() & y.isNotNull()
    return F.avg(F.when(both, y)) - slope(y, x) * F.avg(F.when(both, x))


def skew_sample(v: Column | str) -> Column:
    """Bias-corrected skewness (G1); Spark's own is the population form."""
    v = col(v)
    n = F.count(v).cast("double")
    return F.when(n > 2, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(v))


def kurt_sample(v: Column | str) -> Column:
    """Bias-corrected excess kurtosis (G2)."""
    v = col(v)
    n = F.count(v).cast("double")
    return F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6.0))


def quantile(v: Column | str, q: float) -> Column:
    """Exact linear-interpolated quantile. Groups must be bounded (a day, a block, a state's calendar)."""
    return F.percentile(col(v), F.lit(q))


def rank_corr(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Spearman correlation for several column pairs at once, in long form (keys, pair, rho, n).

    All pairs are unpivoted first, so one shuffle on (keys, pair) serves every ranking.
    Ties take the average rank; constant or single-row input gives 0.
    """
    items = [F.struct(F.lit(name).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
             for name, (a, b) in pairs.items()]
    long = (df.select(*keys, F.explode(F.array(*items)).alias("p")).select(*keys, "p.*")
            .where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    group = [*keys, "pair"]

    def avg_rank(c: str) -> Column:
        w = Window.partitionBy(*group).orderBy(c)
        ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return F.rank().over(w) + (ties - 1) / 2.0

    ranked = long.select(*group, avg_rank("x").alias("rx"), avg_rank("y").alias("ry"))
    return ranked.groupBy(*group).agg(F.coalesce(pearson("rx", "ry"), F.lit(0.0)).alias("rho"), F.count(F.lit(1)).alias("n"))


def rank_corr_wide(df: DataFrame, keys: Sequence[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``rank_corr`` with one column per pair; a pair without rows is 0."""
    long = rank_corr(df, keys, pairs)
    wide = long.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("pair") == p, F.col("rho"))), F.lit(0.0)).alias(p) for p in pairs])
    return wide


def top_by(value: Column | str, weight: Column | str, tie: Column | str) -> Column:
    """Value at the largest weight; among ties the one with the smallest ``tie`` (first in time)."""
    return F.max_by(col(value), F.when(col(weight).isNotNull(), F.struct(col(weight), -col(tie))))


def bottom_by(value: Column | str, weight: Column | str, tie: Column | str) -> Column:
    return F.min_by(col(value), F.when(col(weight).isNotNull(), F.struct(col(weight), col(tie))))


def median_of(values: Column) -> Column:
    """Median of an array without nulls (NULL when empty)."""
    a, n = F.array_sort(values), F.size(values)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2 + 1).cast("int")
    return F.when(n > 0, (F.try_element_at(a, F.greatest(lo, F.lit(1))) + F.try_element_at(a, F.greatest(F.least(hi, n), F.lit(1)))) / 2.0)


def windowed_median(value: Column | str, window) -> Column:
    """Exact median over a short bounded frame (window medians accept no frame of their own)."""
    return median_of(F.collect_list(col(value)).over(window))
