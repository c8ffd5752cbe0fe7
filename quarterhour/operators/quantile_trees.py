"""Boosted quantile trees for all regions at once: pinball loss, binned features, one aggregate per tree level.

Every region gets models of its own for every quantile, yet all are grown by the same jobs: histograms are keyed by (region,
quantile, node, feature, bin). A task sums the loss's gradients of its rows into these cells, Spark adds the cells up, chooses each
node's split, and only the splits (at most 2^depth rows per region and quantile) come back. Leaves hold quantiles of the
residuals in them, since gradients alone say no more than a direction. Rows are binned once and stored; a prediction is
always made from the bins and the trees so far, so nothing grows from round to round but the trees.

A missing feature has a bin of its own, the lowest, and no value takes its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.sources.stage import shared

LEVELS = (0.1, 0.5, 0.9)


@dataclass
class Tree:
    """A complete binary tree in heap order: a row goes right of ``node`` if its bin of feature[node] is above bin[node]."""

    depth: int
    feature: np.ndarray = field(init=False)
    bin: np.ndarray = field(init=False)
    leaf: np.ndarray = field(init=False)

    def __post_init__(self):
        self.feature, self.bin, self.leaf = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, 255), np.zeros(2**self.depth)

    def place(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Place of each row among the nodes of a level, from the left."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(level):
            node = 2 * node + 1 + (bins[np.arange(len(bins)), self.feature[node]] > self.bin[node])
        return node - (2**level - 1)


@dataclass
class Boosted:
    """Per (region, quantile): the start, the trees, and how many of them to use."""

    features: list[str]
    levels: tuple[float, ...]
    rate: float
    edges: dict[str, list[list[float]]]
    start: dict[tuple[str, int], float] = field(default_factory=dict)
    trees: dict[tuple[str, int], list[Tree]] = field(default_factory=dict)
    rounds: dict[tuple[str, int], int] = field(default_factory=dict)

    def score(self, region: str, level: int, bins: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.full(len(bins), self.start.get((region, level), np.nan))
        for tree in self.trees.get((region, level), [])[:rounds]:
            out += self.rate * tree.leaf[tree.place(bins, tree.depth)]
        return out


def bin_edges(df: DataFrame, features: Sequence[str], bins: int, by: str) -> dict[str, list[list[float]]]:
    """Per region and feature: distinct quantiles that part the known values."""
    shares = [i / bins for i in range(1, bins)]
    rows = df.groupBy(by).agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 10_000).alias(c) for c in features]).collect()  # one row per region
    return {r[by]: [sorted(set(r[c] or [])) for c in features] for r in rows}


def binned(df: DataFrame, features: Sequence[str], edges: dict[str, list[list[float]]], by: str) -> DataFrame:
    """Adds ``bins``: per feature 0 if missing, else 1 plus the number of edges below the value."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    schema = df.select(by, "bins_id", F.lit(b"").alias("bins")).schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions = np.array(batch.column(0).to_pylist(), object)
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(features))], axis=1) if len(regions) else np.zeros((0, len(features)))
            out = np.zeros(x.shape, np.uint8)
            for region in set(regions):
                own = np.flatnonzero(regions == region)
                for i, e in enumerate(edges.get(region, [[]] * len(features))):
                    v = x[own, i]
                    out[own, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(np.array(e), v, side="left"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in out], pa.binary())], names=schema.names)

    return df.select(by, "bins_id", *cols).mapInArrow(task, schema)


def _by_region(batch: pa.RecordBatch, width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(region, bins, target) of a batch with the columns region, bins, target."""
    regions = np.array(batch.column(0).to_pylist(), object)
    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, width)
    y = batch.column(2).to_numpy(zero_copy_only=False)
    for region in dict.fromkeys(regions.tolist()):
        own = regions == region
        yield region, bins[own].astype(np.int64), y[own]


def _histograms(model: Boosted, growing: dict[tuple[str, int], Tree], level: int, width: int, bins: int) -> Callable:
    """Gradient sums and counts of a task's rows, by region, quantile, node, feature and bin."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for region, x, y in _by_region(batch, width):
                for q, alpha in enumerate(model.levels):
                    g = alpha - (y < model.score(region, q, x))
                    node = growing[region, q].place(x, level)
                    sums = cells.setdefault((region, q), np.zeros((2, width, 2**level * bins)))
                    for f in range(width):
                        at = node * bins + x[:, f]
                        sums[0, f] += np.bincount(at, g, 2**level * bins)
                        sums[1, f] += np.bincount(at, minlength=2**level * bins)
        for (region, q), (g, n) in cells.items():
            f, at = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([region] * len(f), pa.string()), pa.array(np.full(len(f), q, np.int32)), pa.array((at // bins).astype(np.int32)), pa.array(f.astype(np.int32)), pa.array((at % bins).astype(np.int32)),
                                              pa.array(g[f, at]), pa.array(n[f, at])], names=["region", "q", "node", "feature", "bin", "g", "n"])
    return task


def _best_splits(histograms: DataFrame, min_leaf: int) -> DataFrame:
    """The split of each node that takes most from the squared gradients; nodes without a valid one are left out."""
    cells = histograms.groupBy("region", "q", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
    whole = Window.partitionBy("region", "q", "node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = cells.select("*", F.sum("g").over(upto).alias("gl"), F.sum("n").over(upto).alias("nl"), F.sum("g").over(whole).alias("ga"), F.sum("n").over(whole).alias("na"))
    c = c.withColumn("nr", F.col("na") - F.col("nl")).where((F.col("nl") >= min_leaf) & (F.col("nr") >= min_leaf))
    gain = F.col("gl") * F.col("gl") / F.col("nl") + (F.col("ga") - F.col("gl")) * (F.col("ga") - F.col("gl")) / F.col("nr") - F.col("ga") * F.col("ga") / F.col("na")
    c = c.withColumn("gain", F.round(gain, 9)).where("gain > 0")  # rounded, so that the order of sums decides no tie
    return c.groupBy("region", "q", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))).alias("s")).select("region", "q", "node", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"))


def _residuals(model: Boosted, growing: dict[tuple[str, int], Tree], width: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, x, y in _by_region(batch, width):
                for q in range(len(model.levels)):
                    tree = growing[region, q]
                    leaf = tree.place(x, tree.depth).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([region] * len(y), pa.string()), pa.array(np.full(len(y), q, np.int32)), pa.array(leaf), pa.array(y - model.score(region, q, x))], names=["region", "q", "leaf", "residual"])
    return task


def _losses(model: Boosted, width: int, rounds: int) -> Callable:
    """Pinball loss of a task's rows after each number of rounds."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, x, y in _by_region(batch, width):
                for q, alpha in enumerate(model.levels):
                    e = [y - model.score(region, q, x, r) for r in range(rounds + 1)]
                    loss = [float(np.maximum(alpha * v, (alpha - 1) * v).sum()) for v in e]
                    yield pa.RecordBatch.from_arrays([pa.array([region] * len(e), pa.string()), pa.array(np.full(len(e), q, np.int32)), pa.array(np.arange(len(e), dtype=np.int32)), pa.array(loss)], names=["region", "q", "rounds", "loss"])
    return task


def fit(df: DataFrame, features: Sequence[str], target: str, levels: tuple[float, ...] = LEVELS, rounds: int = 12, depth: int = 3, rate: float = 0.3, bins: int = 32, min_leaf: int = 20, by: str = "state", validation: Column | None = None) -> Boosted:
    """Models of every region and quantile. Rows for which ``validation`` is true grow no tree; they choose how many trees to
    use, the fewest with the least loss. Without such rows of a region, all are used."""
    known = df.where(F.col(target).isNotNull() & F.col(by).isNotNull()).withColumn("bins_id", F.struct(F.col(target).cast("double").alias("y"), F.lit(False).alias("late") if validation is None else F.coalesce(validation, F.lit(False)).alias("late")))
    early = known.where("not bins_id.late")
    model = Boosted(list(features), tuple(levels), rate, bin_edges(early, features, bins, by))
    width, n_bins = len(features), bins + 2
    rows = shared(binned(known, features, model.edges, by).select(F.col(by).alias("region"), "bins", F.col("bins_id.y").alias("y"), F.col("bins_id.late").alias("late")))
    train = rows.where("not late").select("region", "bins", "y")
    wanted = [F.lit(x) for x in levels]
    for r in train.groupBy("region").agg(F.percentile("y", F.array(*wanted)).alias("p")).collect():
        for q in range(len(levels)):
            model.start[r.region, q], model.trees[r.region, q] = r.p[q], []
    for _ in range(rounds):
        growing = {k: Tree(depth) for k in model.trees}
        for level in range(depth):
            cells = train.mapInArrow(_histograms(model, growing, level, width, n_bins), "region string, q int, node int, feature int, bin int, g double, n double")
            for s in _best_splits(cells, min_leaf).collect():  # at most 2^level rows per region and quantile
                tree, node = growing[s.region, s.q], 2**level - 1 + s.node
                tree.feature[node], tree.bin[node] = s.feature, s.bin
        leaves = train.mapInArrow(_residuals(model, growing, width), "region string, q int, leaf int, residual double").groupBy("region", "q", "leaf").agg(F.percentile("residual", F.array(*wanted)).alias("p"))
        for s in leaves.collect():
            growing[s.region, s.q].leaf[s.leaf] = s.p[s.q]
        for k, tree in growing.items():
            model.trees[k].append(tree)
    late = rows.where("late").select("region", "bins", "y")
    losses = late.mapInArrow(_losses(model, width, rounds), "region string, q int, rounds int, loss double").groupBy("region", "q", "rounds").agg(F.sum("loss").alias("loss"))
    best = losses.groupBy("region", "q").agg(F.min(F.struct(F.round("loss", 6), "rounds")).alias("b"))
    model.rounds = {(r.region, r.q): r.b.rounds for r in best.collect()}
    return model


def predict(df: DataFrame, model: Boosted, keys: Sequence[str], by: str = "state") -> DataFrame:
    """keys and ``quantiles`` (an array in the order of the model's levels, null for a region without a model)."""
    rows = df.withColumn("bins_id", F.struct(*keys))
    width = len(model.features)
    schema = T.StructType([rows.schema["bins_id"], T.StructField("quantiles", T.ArrayType(T.DoubleType()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regions = np.array(batch.column(0).to_pylist(), object)
            bins = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, width).astype(np.int64)
            out = np.full((len(regions), len(model.levels)), np.nan)
            for region in set(regions):
                own = regions == region
                for q in range(len(model.levels)):
                    out[own, q] = model.score(region, q, bins[own], model.rounds.get((region, q)))
            values = [None if np.isnan(r).any() else r.tolist() for r in out]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.list_(pa.float64()))], names=schema.names)

    return binned(rows, model.features, model.edges, by).mapInArrow(task, schema).select("bins_id.*", "quantiles")
