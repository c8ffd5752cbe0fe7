"""Small series for the unit tests."""

import datetime

from pyspark.sql import DataFrame, SparkSession

DAY0 = datetime.date(2024, 1, 1)  # a Monday
LOAD = "state string, date date, block int, load double"


def day(i: int) -> datetime.date:
    return DAY0 + datetime.timedelta(days=i)


def series(spark: SparkSession, days: int, fn=lambda d, b: float(d), state: str = "A", blocks=range(1, 97), skip=()) -> DataFrame:
    rows = [(state, day(d), b, None if (v := fn(d, b)) is None else float(v)) for d in range(days) for b in blocks if (d, b) not in skip]
    return spark.createDataFrame(rows, LOAD)


def as_dict(df: DataFrame, keys: list[str], value: str) -> dict:
    out = {}
    for r in df.select(*keys, value).collect():
        k = tuple(r[c] for c in keys)
        out[k[0] if len(k) == 1 else k] = r[value]
    return out
