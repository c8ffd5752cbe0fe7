"""Isolation forests, one per region: readings that few random cuts set apart are outliers.

Each tree is grown from a sample of up to 256 of the region's rows. The sample is drawn by hash: a row takes part in the trees
whose hash with the row is small, so all days have the same chance, every run draws the same rows, and no row is carried to
trees that do not draw it. A tree is a few hundred nodes; growing is one bounded group per (region, tree). Scores are made by
(region, month), beside which the region's trees are laid, so a hot region is as many tasks as it has months.

Rows that lack one of the columns are neither drawn nor scored; a gap is not a reading of 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.functions.stats import quantile
from quarterhour.operators.features import join_stats
from quarterhour.sources.stage import shared

TREES, SAMPLE, SEED = 100, 256, 42
NODES = "state string, tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"


def average_path(n: int) -> float:
    """Mean depth at which a search among n rows ends: what a leaf of n rows adds to the path."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def samples(df: DataFrame, columns: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """state, tree, x (the columns' values): up to ``sample`` rows per tree, those with the smallest hashes.

    A row is offered to a tree if its hash is below twice the share that fills the sample, which keeps offers few.
    """
    whole = df
    for c in columns:
        whole = whole.where(F.col(c).isNotNull())
    sized = join_stats(whole, ["state"], _n=F.count(F.lit(1)))
    space = 1 << 31
    hashed = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "date", "block"), F.lit(space))
    offered = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) * F.col("_n") < F.lit(2 * sample + 40) * F.lit(space))
    rows = sized.select("state", "date", "block", F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.explode(offered).alias("tree")).withColumn("_h", hashed(F.col("tree")))
    place = F.row_number().over(Window.partitionBy("state", "tree").orderBy("_h", "date", "block"))
    return rows.withColumn("_p", place).where(F.col("_p") <= sample).select("state", "tree", "_h", "date", "block", "x")


def grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """A tree over the sample's rows; ``path`` of a leaf is its depth plus what its rows still add."""
    limit = max(1, math.ceil(math.log2(max(2, len(x)))))
    tree: dict[str, list] = {"feature": [], "cut": [], "left": [], "right": [], "path": []}

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(tree["feature"])
        for k, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("path", depth + average_path(len(rows)))):
            tree[k].append(v)
        low, high = rows.min(axis=0), rows.max(axis=0)
        live = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(live):
            f = int(rng.choice(live))
            cut = float(rng.uniform(low[f], high[f]))
            below = rows[:, f] <= cut
            tree["feature"][me], tree["cut"][me] = f, cut
            tree["left"][me], tree["right"][me] = node(rows[below], depth + 1), node(rows[~below], depth + 1)
        return me

    node(x, 0)
    return tree


def forest(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """The trees as arrays of nodes, node 0 being the root."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "date", "block"])
        state, tree = pdf["state"].iloc[0], int(pdf["tree"].iloc[0])
        grown = grow(np.stack(pdf["x"].to_numpy()), np.random.default_rng([seed, tree, zlib.crc32(str(state).encode())]))
        return pd.DataFrame([{"state": state, "tree": tree, **grown}])

    return drawn.groupBy("state", "tree").applyInPandas(one, NODES)


def path_lengths(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, path: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        n = at[rows]
        at[rows] = np.where(x[rows, feature[n]] <= cut[n], left[n], right[n])
        rows = rows[feature[at[rows]] >= 0]
    return path[at]


def isolation_scores(df: DataFrame, columns: Sequence[str] = ("load", "hour", "dow"), contamination: float = 0.01, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The rows with ``score`` (0 to 1, high for outliers; null where a column is missing) and ``is_anomaly``.

    A row is an anomaly if its score is above the region's (1 - contamination) quantile.
    """
    drawn = shared(samples(df, columns, trees, sample, seed))
    grown = shared(forest(drawn, seed))
    sizes = drawn.groupBy("state", "tree").agg(F.count(F.lit(1)).alias("n")).groupBy("state").agg(F.max("n").alias("n"))
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    rows = df.where(whole).select("state", "date", "block", F.date_trunc("month", "date").cast("date").alias("month"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    months = rows.select(F.col("state").alias("state"), F.col("month").alias("month")).distinct()  # columns of their own, apart from the rows'
    beside = grown.join(sizes, "state").join(months, "state")
    out = T.StructType([*[rows.schema[c] for c in ("state", "date", "block")], T.StructField("score", T.DoubleType())])

    def score(points: pd.DataFrame, trees_: pd.DataFrame) -> pd.DataFrame:
        if points.empty or trees_.empty:
            return pd.DataFrame(columns=out.names)
        x = np.stack(points["x"].to_numpy())
        trees_ = trees_.sort_values("tree")
        paths = [path_lengths(x, *[np.asarray(getattr(t, c)) for c in ("feature", "cut", "left", "right", "path")]) for t in trees_.itertuples(index=False)]
        usual = average_path(int(trees_["n"].iloc[0]))
        return points[["state", "date", "block"]].assign(score=2.0 ** (-np.mean(paths, axis=0) / usual) if usual else 0.5)

    scored = rows.groupBy("state", "month").cogroup(beside.groupBy("state", "month")).applyInPandas(score, out)
    scored = join_stats(scored, ["state"], _cut=quantile("score", 1 - contamination))
    scored = scored.select("state", "date", "block", "score", (F.col("score") > F.col("_cut")).alias("is_anomaly"))
    return df.join(scored, ["state", "date", "block"], "left").withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))
