"""Named exploration views: one function per view, the same signature for all, no serving layer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterhour.functions.stats import rank_corr
from quarterhour.operators import anomaly, decompose, kpis
from quarterhour.operators.reports import unpivot
from quarterhour.schema import check_feature


def _corr(df: DataFrame, feature: str) -> DataFrame:
    cols = [c for c in ("temperature", "humidity") if c in df.columns]
    r = rank_corr(df, ["state"], {c: (feature, c) for c in cols})
    return r.select("state", F.col("pair").alias("metric"), F.col("rho").alias("value"))


def _wide(fn: Callable[[DataFrame, str], DataFrame]) -> Callable[[DataFrame, str], DataFrame]:
    return lambda df, feature: unpivot(fn(df, feature), ["state"])


# view -> function(df, feature) -> (state, metric, value)
VIEWS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "standard_kpis": _wide(kpis.standard),
    "hourly_kpis": _wide(kpis.on_hourly_means),
    "load_state": _wide(kpis.load_state),
    "shape": _wide(kpis.shape),
    "ramps": _wide(lambda df, f: kpis.ramps(df)),
    "temporal": _wide(kpis.temporal),
    "distribution": _wide(kpis.distribution),
    "duration": _wide(kpis.duration_p95),
    "risk_monitor": _wide(lambda df, f: anomaly.risk_monitor(df, f).drop("risk_level", "momentum")),
    "decomposition": _wide(decompose.contribution),
    "weather_correlation": _corr,
}


def dispatch(df: DataFrame, names: Sequence[str], feature: str = "load") -> DataFrame:
    """Run several views and stack their metrics."""
    check_feature(feature)
    out = None
    for n in names:
        if n not in VIEWS:
            raise ValueError(f"unknown view {n!r}; expected one of {sorted(VIEWS)}")
        part = VIEWS[n](df, feature).select("state", F.lit(n).alias("view"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
