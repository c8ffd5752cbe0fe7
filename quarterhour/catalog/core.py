"""Registry of named queries, each with its output contract and an optional SQL twin.

The contract is a string such as ``"state date block:i load:f"``. ``:f`` marks a double that is rounded to four
places, ``:i`` a 64-bit integer. Both sides are cast and rounded by the same contract, so a query and its twin
agree on names and types by construction. Doubles are moved by 1e-9 before rounding: sums of doubles depend on
the order of rows in the last bits, and exact halves would otherwise round either way.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterhour.catalog.views import CTES, Views

NUDGE = 1e-9
DIGITS = 4


@dataclass(frozen=True)
class Entry:
    name: str
    fn: Callable[[Views], DataFrame]
    cols: str
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, cols: str, sql: str | None = None):
    """Register a query under ``name``."""
    def add(fn):
        assert name not in REGISTRY, name
        REGISTRY[name] = Entry(name, fn, cols, sql)
        return fn
    return add


def contract(cols: str) -> list[tuple[str, str]]:
    return [(c.partition(":")[0], c.partition(":")[2]) for c in cols.split()]


def finish(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in contract(cols):
        c = F.col(name)
        if kind == "f":
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


def _needed(sql: str) -> list[str]:
    """Views used by a statement, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)
    visit(sql)
    return [n for n in CTES if n in order]


def twin(entry: Entry) -> str:
    """SQL statement with the fixture views in front and the contract around it."""
    body = entry.sql.strip()
    ctes = [f"{n} AS ({CTES[n].strip()})" for n in _needed(body)]
    ctes.append(f"result_rows AS ({body})")
    out = []
    for name, kind in contract(entry.cols):
        if kind == "f":
            out.append(f'round(CAST("{name}" AS DOUBLE) + 1e-9, {DIGITS}) + CAST(0 AS DOUBLE) AS "{name}"')
        elif kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        else:
            out.append(f'"{name}"')
    return "WITH " + ",\n".join(ctes) + "\nSELECT " + ", ".join(out) + " FROM result_rows"


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    e = REGISTRY[name]
    return finish(e.fn(Views(spark, sf_dir)), e.cols)
