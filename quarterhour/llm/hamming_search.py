"""Exact top-k search over binary codes by multi-index hashing.

A code of 64 bits is cut into m segments of about log2(rows) - 2 bits, so an index entry (segment, value) points to a few
codes, kept as one array; an entry with more than CHUNK codes is several arrays. A query's segments are looked up with all
flips of 0 bits, then 1, 2 ... bits, and all distances of an array are verified within its row: what leaves it are the k
nearest that can still improve on the query's k-th distance so far. So a join makes a row per probe and array, not per
candidate, and a value that many codes share is dealt to many rows. Once the first j segments have been searched up to r flips and the others up to r - 1, every code within distance
m * r + j - 1 has been seen, as a farther one only can differ in more bits everywhere. A query whose k-th distance is
within that leaves the loop, so only the hard ones reach large radii. Radii with many flips grow segment by segment.

Copies are collapsed first: the index holds distinct codes, each with its k smallest ids (more of one code can never be
among the nearest k), and queries with one code are searched once.

Defined results: neighbours are ordered by distance, then id; a query row finds itself. Rows with null id or whose vector does
not have exactly as many components as a code has bits have no code: they find nothing and are not found; a null or NaN component counts as not positive. Rows that
repeat an id and code count once. With fewer than k rows each query finds them all. Further columns are not looked at.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.llm.common import saved

BITS, K = 64, 10
#: Radii with more flips than this grow one segment at a time.
AT_ONCE = 256
#: Codes in one array of the index.
CHUNK = 256


def sign_code(vector: str, bits: int = BITS) -> Column:
    """Bit i is set where component i is positive; null for a null vector or one of another length."""
    bit = lambda i: F.when((F.get(vector, F.lit(i)) > 0) & ~F.isnan(F.get(vector, F.lit(i))), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, bits):
        code = code.bitwiseOR(bit(i))
    return F.when(F.size(vector) == bits, code)


def cuts(rows: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of segments of about log2(rows) - 2 bits, so that an index entry holds a few codes."""
    m = min(bits, math.ceil(bits / max(1.0, math.log2(max(rows, 2)) - 2)))
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else code


def steps(parts: list[tuple[int, int]]) -> list[tuple[int, list[int], int]]:
    """(radius, segments to search, distance covered afterwards), until everything is covered."""
    out, m = [], len(parts)
    for radius in range(max(width for _, width in parts) + 1):
        groups = [list(range(m))] if math.comb(max(width for _, width in parts), radius) <= AT_ONCE else [[j] for j in range(m)]
        out += [(radius, group, m * radius + group[-1]) for group in groups]
    return out


def flips(width: int, radius: int) -> Column:
    """All masks of ``width`` bits with ``radius`` set, as one constant array."""
    masks = [sum(1 << i for i in chosen) for chosen in combinations(range(width), radius)]
    return F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")


def index(ids: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """seg, value, codes: arrays of at most about CHUNK (code, its smallest id)."""
    codes = ids.groupBy("code").agg(F.min("vec_id").alias("first_id"))
    entries = F.array(*[F.struct(F.lit(j).alias("seg"), segment(F.col("code"), *p).alias("value")) for j, p in enumerate(parts)])
    flat = codes.select("code", "first_id", F.explode(entries).alias("e")).select("code", "first_id", "e.*")
    crowded = flat.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
    chunk = F.coalesce(F.pmod(F.xxhash64("code"), F.ceil(F.col("n") / CHUNK)), F.lit(0))
    return flat.join(crowded, ["seg", "value"], "left").groupBy("seg", "value", chunk.alias("chunk")).agg(F.collect_list(F.struct("code", "first_id")).alias("codes")).drop("chunk")


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, distance. Both frames hold (vec_id, code)."""
    by_code = Window.partitionBy("code").orderBy("vec_id")
    ids = saved(rows.where("vec_id is not null and code is not null").distinct().withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= k).drop("place"))
    known = ids.count()
    parts, wanted = cuts(ids.select("code").distinct().count()), min(k, known)
    asked = saved(queries.where("vec_id is not null and code is not null").select(F.col("vec_id").alias("query_id"), F.col("code").alias("asked")).distinct())
    if not known:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).alias("distance")).where(F.lit(False))
    chunks = saved(index(ids, parts))

    # The k nearest codes of an array, by distance and smallest id: whatever is among the k nearest ids of all has its code there.
    measured = F.transform("codes", lambda c: F.struct(F.bit_count(F.col("asked").bitwiseXOR(c["code"])).alias("distance"), c["first_id"].alias("first_id"), c["code"].alias("code")))
    near = F.slice(F.array_sort(F.filter(measured, lambda c: c["distance"] <= F.col("far"))), 1, k)
    everyone = asked.select("asked").distinct()
    active, found = everyone.withColumn("far", F.lit(BITS)), None
    for radius, group, covered in steps(parts):
        probes = None
        for j in group:
            shift, width = parts[j]
            if radius <= width:
                own = active.select("asked", "far", F.lit(j).alias("seg"), segment(F.col("asked"), shift, width).alias("own"), F.explode(flips(width, radius)).alias("mask")).select("asked", "far", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
                probes = own if probes is None else probes.union(own)
        if probes is None:
            continue  # this segment is narrower than the radius
        hits = probes.join(chunks, ["seg", "value"]).select("asked", near.alias("near")).where(F.size("near") > 0)
        fresh = hits.select("asked", F.explode("near.code").alias("code")).distinct().join(ids, "code").select("asked", "vec_id", F.bit_count(F.col("asked").bitwiseXOR(F.col("code"))).alias("distance"))
        best = Window.partitionBy("asked").orderBy("distance", "vec_id")
        merged = fresh if found is None else fresh.union(found).distinct()
        found = saved(merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
        state = found.groupBy("asked").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        far = F.when(F.col("n") >= wanted, F.col("kth")).otherwise(F.lit(BITS))
        open_ = F.coalesce((F.col("n") < wanted) | (F.col("kth") > covered), F.lit(True))  # who is done stays done, as more is covered later
        active = saved(everyone.join(state, "asked", "left").where(open_).select("asked", F.coalesce(far, F.lit(BITS)).alias("far")))
        if active.isEmpty():
            break
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy("distance", "vec_id")))
    return asked.join(ranked, "asked").select("query_id", "rank", "vec_id", "distance")
