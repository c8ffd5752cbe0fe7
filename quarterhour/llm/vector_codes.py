"""Vector code compression: product codes, with each part's nearest entry found by equal-average search.

Components become integers, floor(1024 * x), and everything after that is exact integer arithmetic, so results do not depend on
partitioning. A vector is cut into four equal parts; each part position has a codebook of 256 entries, which starts as that
part of the 256 vectors with the smallest ids and goes through four rounds of assigning and averaging (rounded down).

Search: entries are sorted by the sum of their components. By Cauchy-Schwarz a part of d components is at least
(difference of sums)^2 / d away from an entry, so a search starts where the part's own sum belongs and expands outward on both
sides until that bound is strictly above the best distance; at equality the entry could still tie with a lower index. Parts
with similar sums expand together, sixteen entries at a time, each only as long as its own bound allows.

A task sums its parts per entry and returns at most 4 x 256 rows, which Spark adds up; only the codebooks reach the driver.

Defined results: rows whose vector is null, or holds a null or non-finite component, are dropped. The dimension is that of the
smallest id whose vector's length is a positive multiple of four; kept vectors of another length have a null code and error.
Rows of one id are ordered by their components, null ids last. Unused entries stay as they are. Equal labels add up, nulls
together; an empty table has no rows. Components and sums beyond
64 bits are the largest 64-bit number. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import records, saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts searched together, and entries looked at in one step. Both change cost only.
TOGETHER, STEP = 1024, 16
#: Rows of a label that meet its sum in one task.
LABEL_ROWS, LEAST_SPREAD = 100_000, 64
LARGEST = (1 << 63) - 1

Codebooks = list[list[list[int]]]  # by part, entry, component


def finite(vector: Column) -> Column:
    """No null, no NaN and no infinite component."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each vector's nearest entry, the lowest index of the nearest ones.

    Integer arrays, of one row per vector and per entry. Whatever 53 bits cannot hold is computed with Python's integers.
    """
    n, dim = vectors.shape
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * dim * largest**2 < 1 << 53 else object
    vectors, entries = vectors.astype(kind), entries.astype(kind)
    own_sums, entry_sums = vectors.sum(axis=1), entries.sum(axis=1)
    by_sum = np.argsort(entry_sums, kind="stable")
    sums = entry_sums[by_sum]
    norms = (vectors * vectors).sum(axis=1), (entries * entries).sum(axis=1)
    chosen, distance = np.zeros(n, np.int64), np.empty(n, kind)
    order = np.argsort(own_sums, kind="stable")
    for first in range(0, n, TOGETHER):
        rows = order[first:first + TOGETHER]
        own, own_norm, s = vectors[rows], norms[0][rows], own_sums[rows]
        best, index = np.full(len(rows), np.inf, kind), np.full(len(rows), len(entries), np.int64)
        left = right = int(np.searchsorted(sums, s[len(s) // 2]))
        while left > 0 or right < len(sums):
            for side in ("right", "left"):
                if side == "right" and right < len(sums):
                    edge, block = sums[right], by_sum[right:right + STEP]
                    open_ = (s >= edge) | ((edge - s) ** 2 <= dim * best)
                    right = right + STEP if open_.any() else len(sums)
                elif side == "left" and left > 0:
                    edge, block = sums[left - 1], by_sum[max(0, left - STEP):left]
                    open_ = (s <= edge) | ((s - edge) ** 2 <= dim * best)
                    left = left - STEP if open_.any() else 0
                else:
                    continue
                at = np.flatnonzero(open_.astype(bool))
                if len(at):
                    block = np.sort(block)  # of equal distances, argmin takes the first
                    d = own_norm[at][:, None] - 2 * (own[at] @ entries[block].T) + norms[1][block]
                    nearest_ = d.argmin(axis=1)
                    found, name = d[np.arange(len(at)), nearest_], block[nearest_]
                    better = ((found < best[at]) | ((found == best[at]) & (name < index[at]))).astype(bool)
                    best[at[better]], index[at[better]] = found[better], name[better]
        chosen[rows], distance[rows] = index, best
    return chosen, distance if kind is object else distance.astype(np.int64)


def floored(vectors: pa.Array, dim: int) -> np.ndarray:
    """The components of vectors of one length, as integers."""
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if np.abs(values).max(initial=0) < 1 << 62:
        return values.astype(np.int64).reshape(-1, dim)
    return np.array([max(~LARGEST, min(LARGEST, int(v))) for v in values], object).reshape(-1, dim)


def whole(vectors: pa.Array) -> pa.Array:
    """Which vectors are there and finite."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = pc.fill_null(vectors.flatten(), float("nan")).to_numpy(zero_copy_only=False)
    bad_before = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False))
    starts = np.concatenate([[0], ends[:-1]])
    return pa.array((bad_before[ends] == bad_before[starts]) & vectors.is_valid().to_numpy(zero_copy_only=False))


def part_sums(books: Codebooks, dim: int):
    """Per part and entry: rows, and the sum of each component, of a task's vectors."""
    sub = dim // PARTS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(b, object) for b in books]
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        sums = np.zeros((PARTS, len(books[0]), sub), object)
        for batch in batches:
            fit = pc.equal(pc.list_value_length(batch.column(0)), dim)
            own = batch.column(0).filter(fit)
            vectors = floored(own.filter(whole(own)), dim) if len(own) else np.zeros((0, dim), np.int64)
            for p in range(PARTS):
                part = vectors[:, p * sub:(p + 1) * sub]
                chosen, _ = nearest(part, tables[p])
                order = np.argsort(chosen, kind="stable")
                names, starts, n = np.unique(chosen[order], return_index=True, return_counts=True)
                if len(names):
                    counts[p, names] += n
                    # A batch's sums fit into 64 bits wherever its components are below 2^40; larger ones are Python's integers.
                    small = part.dtype != object and np.abs(part).max() < 1 << 40
                    sums[p, names] += np.add.reduceat(part[order] if small else part[order].astype(object), starts, axis=0).astype(object)
        p, e = np.nonzero(counts)
        columns = {"part": (p.tolist(), pa.int32()), "entry": (e.tolist(), pa.int32()), "n": (counts[p, e].tolist(), pa.int64())}
        columns |= {f"s{i}": ([Decimal(int(x)) for x in sums[p, e, i]], pa.decimal128(38, 0)) for i in range(sub)}
        yield records(columns)

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(sub))
    return task, schema


def codebooks(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[Codebooks, int, int]:
    """The fitted codebooks, the dimension they are for, and the number of rows they were fitted on."""
    vector = F.col(vector_col)
    kept = rows.where(finite(vector) & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)).select(F.col(id_col).alias("vec_id"), integers(vector).alias("v"))
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    smallest = kept.orderBy(*by_id).limit(1).collect()
    if not smallest:
        return [], 0, 0
    dim = len(smallest[0].v)
    sub = dim // PARTS
    start = [r.v for r in kept.where(F.size("v") == dim).orderBy(*by_id).limit(ENTRIES).collect()]
    books = [[v[p * sub:(p + 1) * sub] for v in start] for p in range(PARTS)]
    known = 0
    for _ in range(ROUNDS):
        task, schema = part_sums(books, dim)
        sums = rows.select(vector_col).mapInArrow(task, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(sub)])
        found = sums.collect()  # at most one row per part and entry
        known = sum(r.n for r in found if r.part == 0)
        for r in found:
            books[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(sub)]
    return books, dim, known


def codebooks_digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def coded(rows: DataFrame, books: Codebooks, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code and error of every kept row."""
    sub, out = dim // PARTS, rows.select(id_col, vector_col, label_col).schema
    schema = T.StructType([T.StructField("vec_id", out[id_col].dataType), T.StructField("label", out[label_col].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.array(b, object) for b in books]
        for batch in batches:
            batch = batch.filter(whole(batch.column(1)))
            fit = pc.equal(pc.list_value_length(batch.column(1)), dim) if books else pa.array(np.zeros(batch.num_rows, bool))
            other, batch = batch.filter(pc.invert(fit)), batch.filter(fit)
            for b, known in ((other, False), (batch, True)):
                if not b.num_rows:
                    continue
                codes, errors = pa.nulls(b.num_rows, pa.string()), pa.nulls(b.num_rows, pa.int64())
                if known:
                    vectors = floored(b.column(1), dim)
                    found = [nearest(vectors[:, p * sub:(p + 1) * sub], tables[p]) for p in range(PARTS)]
                    codes = pa.array(["".join(f"{c:02x}" for c in four) for four in zip(*[f[0].tolist() for f in found], strict=True)], pa.string())
                    errors = pa.array([min(LARGEST, sum(map(int, four))) for four in zip(*[f[1].tolist() for f in found], strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), codes, errors], names=schema.names)

    return rows.select(id_col, vector_col, label_col).mapInArrow(task, schema)


def compressed(rows: DataFrame, **columns: str) -> DataFrame:
    """vec_id, code, error, label_error (error summed over the rows of the same label) and codebooks_sha256."""
    books, dim, known = codebooks(rows, **{k: v for k, v in columns.items() if k != "label_col"})
    # A label with a third of all rows is dealt to as many keys as it needs; a row's share does not depend on its values.
    spread = max(LEAST_SPREAD, known // LABEL_ROWS)
    found = saved(coded(rows, books, dim, **columns).withColumn("share", F.monotonically_increasing_id() % spread))
    sums = found.groupBy("label", "share").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("share_error"))
    total = F.sum("share_error")
    totals = sums.groupBy(F.col("label").alias("of")).agg(F.when(total > LARGEST, F.lit(LARGEST)).otherwise(total).cast("long").alias("label_error"))
    per_share = sums.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("of", F.col("share").alias("of_share"), "label_error")
    joined = found.join(per_share, F.col("label").eqNullSafe(F.col("of")) & (F.col("share") == F.col("of_share")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
