"""Peaks by prominence, slice by slice.

A series is cut into slices of four weeks. Within its slice a reading finds the nearest higher reading on each side, or learns that
there is none, and the lowest reading on the way. What leaves a slice is short: its peaks, its first and last level run (which may
go on in the next slice), its highest and lowest reading, and two staircases. A staircase holds the record highs seen from one
end of the slice, each with the lowest reading passed before it. A peak that is higher than the rest of its slice then finds the
nearest slice that holds a higher reading, takes the lowest readings of the slices between, and reads the last part of the
way off that slice's staircase. So no task holds more than one slice's readings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.functions.blocks import BLOCKS_PER_DAY, block_index
from quarterhour.sources.stage import shared

SLICE_DAYS = 28
STEP = "struct<high: double, low: double>"


def _ways(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """Going back from each reading: the lowest one (itself included) up to the next higher, whether there is a higher one, and
    the staircase as seen from the end: record highs with the lowest reading passed before each."""
    low, hit = np.empty(len(v)), np.zeros(len(v), bool)
    stack: list[tuple[float, float]] = []
    for i, x in enumerate(v):
        least = x
        while stack and stack[-1][0] <= x:
            least = min(least, stack.pop()[1])
        low[i], hit[i] = least, bool(stack)
        stack.append((x, least))
    stairs, passed = [], np.inf
    for high, least in reversed(stack):
        stairs.append((high, passed))
        passed = min(passed, least)
    return low, hit, stairs


STAIRS = pa.list_(pa.struct([("high", pa.float64()), ("low", pa.float64())]))
FOUND = [("kind", pa.string()), ("v", pa.float64()), ("t", pa.int64()), ("times", pa.list_(pa.int64())), ("before", pa.float64()), ("after", pa.float64()), ("left_low", pa.float64()), ("left_hit", pa.bool_()),
         ("right_low", pa.float64()), ("right_hit", pa.bool_()), ("stairs_back", STAIRS), ("stairs_ahead", STAIRS)]


def _read_slice(table: pa.Table, keys: list[str]) -> pa.Table:
    """Rows of three kinds: ``slice`` (one), ``run`` (the first and the last run of equal readings) and ``peak`` (runs between)."""
    table = table.sort_by("t")
    v, t = table["v"].to_numpy(), table["t"].to_numpy()
    back_low, back_hit, suffix = _ways(v)
    low, hit, prefix = _ways(v[::-1])
    ahead_low, ahead_hit = low[::-1], hit[::-1]
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    ends = np.concatenate([starts[1:], [len(v)]]) - 1
    steps = lambda stairs: [{"high": h, "low": None if passed == np.inf else passed} for h, passed in stairs]
    rows = [{"kind": "slice", "v": v.max(), "left_low": v.min(), "stairs_back": steps(suffix), "stairs_ahead": steps(prefix)}]
    for n, (a, b) in enumerate(zip(starts, ends, strict=True)):
        first, last = n == 0, n == len(starts) - 1
        before, after = None if first else v[a - 1], None if last else v[b + 1]
        if first or last or (before < v[a] and after < v[a]):
            rows.append({"kind": "run" if first or last else "peak", "v": v[a], "t": t[a], "times": t[a:b + 1].tolist() if first or last else [t[a + (b - a) // 2]], "before": before, "after": after,
                         "left_low": back_low[a], "left_hit": bool(back_hit[a]), "right_low": ahead_low[b], "right_hit": bool(ahead_hit[b])})
    same = [table.schema.field(k) for k in (*keys, "slice")]
    found = pa.Table.from_pylist(rows, pa.schema(FOUND))
    return pa.Table.from_arrays([*[pa.array([table[f.name][0].as_py()] * len(rows), f.type) for f in same], *found.columns], names=[*[f.name for f in same], *found.column_names])


def _joined_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Peaks among the runs at the edges of slices, which are one run if their readings are equal. At most two rows per slice."""
    w = Window.partitionBy(*keys).orderBy("t")
    # The last run of one slice and the first of the next are neighbours; two runs of one slice may have others between them.
    joins = (F.lag("v").over(w) == F.col("v")) & F.col("before").isNull()
    r = runs.withColumn("_run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = Window.partitionBy(*keys, "_run")
    r = r.withColumn("_n", F.sum(F.size("times")).over(g)).withColumn("_upto", F.sum(F.size("times")).over(g.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    place = F.floor((F.col("_n") + 1) / 2)  # the middle one of all its readings
    middle = F.when((place <= F.col("_upto")) & (place > F.col("_upto") - F.size("times")), F.get("times", (place - (F.col("_upto") - F.size("times")) - 1).cast("int")))
    runs_ = r.withColumn("_mid", middle).groupBy(*keys, "_run").agg(
        F.max("v").alias("v"), F.min("t").alias("t"), F.max("_mid").alias("mid"), *[F.min_by(c, "t").alias(c) for c in ("before", "left_low", "left_hit")], F.min("slice").alias("left_slice"),
        *[F.max_by(c, "t").alias(c) for c in ("after", "right_low", "right_hit")], F.max("slice").alias("right_slice"))
    before, after = F.coalesce("before", F.lag("v").over(w)), F.coalesce("after", F.lead("v").over(w))
    return runs_.withColumn("_b", before).withColumn("_a", after).where((F.col("_b") < F.col("v")) & (F.col("_a") < F.col("v")))


def _beyond(peaks: DataFrame, slices: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``left`` and ``right``: the lowest reading up to the next higher one, beyond the peak's own slice where it has none.

    Beside a peak lie the highest and lowest readings of its series' slices (thirteen a year); staircases are joined for the one
    slice on each side that ends the way.
    """
    ends = slices.groupBy(*keys).agg(F.collect_list(F.struct("slice", F.col("v").alias("high"), F.col("left_low").alias("low"))).alias("_s"))
    out = peaks.join(ends, keys)
    for side, stairs in (("left", "stairs_back"), ("right", "stairs_ahead")):
        own, at = F.col(f"{side}_slice"), f"_{side}_at"
        past = (lambda a, b: a < b) if side == "left" else (lambda a, b: a > b)
        nearest = F.array_max if side == "left" else F.array_min
        higher = F.filter("_s", lambda s: past(s["slice"], own) & (s["high"] > F.col("v")))  # noqa: B023
        out = out.withColumn(at, F.when(~F.col(f"{side}_hit"), nearest(F.transform(higher, lambda s: s["slice"]))))
        on_way = F.filter("_s", lambda s: past(s["slice"], own) & (F.col(at).isNull() | past(F.col(at), s["slice"])))  # noqa: B023
        between = F.when(~F.col(f"{side}_hit"), F.array_min(F.transform(on_way, lambda s: s["low"])))
        steps = slices.select(*keys, F.col("slice").alias(at), F.col(stairs).alias("_stairs"))
        # The first record that is higher, from the slice's near end.
        last = F.get(F.filter("_stairs", lambda x: x["high"] > F.col("v")), F.lit(0))["low"]
        out = out.withColumn("_between", between).join(steps, [*keys, at], "left").withColumn(side, F.least(f"{side}_low", "_between", last)).drop("_between", "_stairs", at)
    return out.drop("_s")


def peaks_by_prominence(df: DataFrame, prominence: float, feature: str = "load", keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Local maxima that rise at least ``prominence`` above the higher of the two valleys beside them.

    A valley reaches, on each side, to the next reading above the peak or to the end of the series. Level tops count
    once, at their middle. Readings are compared in order of time, missing blocks are skipped, and the first and the last
    reading of a series are no peaks.
    """
    keys = list(keys)
    d = df.where(F.col(feature).isNotNull()).select(*keys, block_index("date", "block").cast("long").alias("t"), F.col(feature).cast("double").alias("v"))
    d = d.withColumn("slice", F.floor(F.col("t") / (SLICE_DAYS * BLOCKS_PER_DAY)).cast("long"))
    kinds = {f.name: f.dataType.simpleString() for f in d.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "slice long, kind string, v double, t long, times array<bigint>, before double, after double, left_low double, left_hit boolean, right_low double, right_hit boolean",
                        f"stairs_back array<{STEP}>, stairs_ahead array<{STEP}>"])
    read = shared(d.groupBy(*keys, "slice").applyInArrow(lambda table: _read_slice(table, keys), schema))
    slices = read.where("kind = 'slice'")
    inner = read.where("kind = 'peak'").withColumns({"mid": F.get("times", F.lit(0)), "left_slice": F.col("slice"), "right_slice": F.col("slice")})
    cols = [*keys, "mid", "v", "left_slice", "left_low", "left_hit", "right_slice", "right_low", "right_hit"]
    peaks = inner.select(*cols).unionByName(_joined_runs(read.where("kind = 'run'"), keys).select(*cols))
    # What lies within its own slice only makes a valley higher, so peaks too low there need not look further.
    peaks = peaks.where(~(F.col("left_hit") & (F.col("v") - F.col("left_low") < prominence)) & ~(F.col("right_hit") & (F.col("v") - F.col("right_low") < prominence)))
    rise = F.col("v") - F.greatest("left", "right")
    found = _beyond(peaks, slices, keys).withColumn("prominence", rise).where(F.col("prominence") >= prominence)
    day = F.floor((F.col("mid") - 1) / BLOCKS_PER_DAY).cast("int")
    return found.select(*keys, F.date_from_unix_date(day).alias("date"), (F.pmod(F.col("mid") - 1, F.lit(BLOCKS_PER_DAY)) + 1).cast("int").alias("block"), F.col("v").alias("load"), "prominence")
