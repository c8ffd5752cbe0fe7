"""Hooks for a caller's own forecast function."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

BLOCKS = 96


def day_forecast(df: DataFrame, fn: Callable[[pd.DataFrame], Sequence[float]], keys: tuple[str, str] = ("state", "date")) -> DataFrame:
    """Run a function on each day (at most 96 rows per group); it must return 96 values, or None to leave the day out."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in keys], "block int, forecast double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = fn(pdf.sort_values("block"))
        if values is None:
            return pd.DataFrame(columns=[*keys, "block", "forecast"])
        values = [float(x) for x in values]
        if len(values) != BLOCKS:
            raise ValueError(f"external forecast returned {len(values)} values, expected {BLOCKS}")
        return pd.DataFrame({keys[0]: [key[0]] * BLOCKS, keys[1]: [key[1]] * BLOCKS, "block": range(1, BLOCKS + 1), "forecast": values})

    return df.groupBy(*keys).applyInPandas(run, schema)
