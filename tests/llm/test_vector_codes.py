"""Vector codes against a plain search over all entries in Python's integers."""

import hashlib
import math
import random

import cases
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarterhour.llm import queries, vector_codes

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def find(part, book):
    return min((distance(part, e), i) for i, e in enumerate(book))


def plain(rows):
    """Contract rows from (vec_id, vector, label)."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[max(-(1 << 63), min((1 << 63) - 1, math.floor(1024 * x))) for x in v] for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))
    usable = [k for k in order if ints[k] and len(ints[k]) % 4 == 0]
    usable = [k for k in usable if len(ints[k]) == len(ints[usable[0]])]
    dim = len(ints[usable[0]]) if usable else 0
    cut = lambda v: [v[p * dim // 4:(p + 1) * dim // 4] for p in range(4)]
    books = [[cut(ints[k])[p] for k in usable[:256]] for p in range(4)] if usable else []
    for _ in range(4 if usable else 0):
        for p in range(4):
            members = {}
            for k in usable:
                members.setdefault(find(cut(ints[k])[p], books[p])[1], []).append(cut(ints[k])[p])
            for e, own in members.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes, errors, by_label = {}, {}, {}
    for k in usable:
        found = [find(part, books[p]) for p, part in enumerate(cut(ints[k]))]
        codes[k], errors[k] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
        by_label[kept[k][2]] = by_label.get(kept[k][2], 0) + errors[k]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return sorted([(kept[k][0], codes.get(k), min(top, errors[k]) if k in errors else None, min(top, by_label[kept[k][2]]) if kept[k][2] in by_label else None, digest) for k in range(len(kept))], key=repr)


def agree(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    want = plain(rows)
    assert cases.rows(vector_codes.compressed(df)) == want
    clashing = df.repartition(7).withColumns({c: F.lit("!") for c in ("v", "share", "of", "of_share", "code", "error", "part", "entry", "n")})
    assert cases.rows(vector_codes.compressed(clashing)) == want
    return want


def test_awkward_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], rnd.choice([0, 1, 2, None])) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8, 5) for i in range(300)] + [(7, [0.25] * 8, 5)] * 3  # a hot vector, a repeated row
    rows += [(2000, None, 1), (2001, [0.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, None), (None, [1.0] * 8, None)]
    rows += [(-1, [1.0, 2.0], 1), (2004, [1.0] * 12, 9), (2005, [], 9), (2006, [-0.0001] * 8, 9)]
    want = agree(spark, rows)
    assert any(r[1] is None for r in want) and len(want) == len(rows) - 4


def test_few_large_and_no_vectors(spark):
    agree(spark, [(3, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], None), (2, [0.0] * 4, None)])
    agree(spark, [(i, [1e12 * i, -3e9, 1e15, 0.1 * i], i % 2) for i in range(30)] + [(90, [1e300] * 4, 3), (91, [-1e300] * 4, 3)])
    agree(spark, [(1, [1.0, 2.0, 3.0], 1)])
    assert vector_codes.compressed(spark.createDataFrame([], VECTORS)).count() == 0
    floats = spark.createDataFrame([(i, [0.1 * i, 0.7, -0.3, 0.2], i) for i in range(9)], "vec_id long, embedding array<float>, label int")
    assert cases.rows(vector_codes.compressed(floats)) == plain([(i, [float(np.float32(x)) for x in v], i) for i, v in [(i, [0.1 * i, 0.7, -0.3, 0.2]) for i in range(9)]])


def test_query_and_its_sql(spark, duck):
    got = cases.rows(queries.op13_vector_codes(spark, SMALL), "vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert got == sorted(duck.execute(queries.SQL["op13_vector_codes"]).fetchall(), key=repr)


@given(st.integers(0, 10_000), st.integers(1, 60), st.integers(1, 5), st.sampled_from([1, 3, 40, 1 << 40]), st.integers(1, 1500))
@settings(max_examples=120, deadline=None)
def test_search_finds_the_lowest_of_the_nearest(seed, entries, dim, reach, n):
    rng = np.random.default_rng(seed)
    n = n if reach < 1 << 30 else min(n, 40)
    vectors, book = rng.integers(-reach, reach + 1, (n, dim)), rng.integers(-reach, reach + 1, (entries, dim))
    index, best = vector_codes.nearest(vectors, book)
    d = ((vectors.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(axis=2)
    assert index.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
