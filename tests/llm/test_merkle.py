"""The Merkle manifest against a plain tree of all rows."""

import hashlib
import zlib

import cases
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarterhour.llm import merkle_manifest as mm
from quarterhour.llm import queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """The root, and per leaf its siblings (left, right) level by level."""
    steps, below = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        upper, owners = [], []
        for i in range(0, len(digests), 3):
            run = digests[i:i + 3]
            for j, own in enumerate(below[i:i + 3]):
                for k in own:
                    steps[k].append(("".join(run[:j]), "".join(run[j + 1:])))
            upper.append(h(*run))
            owners.append(sum(below[i:i + 3], []))
        digests, below = upper, owners
    return digests[0], steps


def plain(rows):
    """Contract rows, from tuples in the order of COLUMNS."""
    names = sorted({r[1] for r in rows}, key=lambda n: (n is not None, (n or "").encode()))
    sources = [sorted((r for r in rows if r[1] == n), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names]
    trees = [tree([leaf(r) for r in own]) for own in sources]
    root, tops = tree([t[0] for t in trees])
    out = []
    for own, (subroot, steps), top in zip(sources, trees, tops, strict=True):
        for r, s in zip(own, steps, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            folded = leaf((*r[:4], r[4].replace("\n", "")) if tampered else r)
            for left, right in s + top:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r), subroot, root, h(*[x for step in s + top for x in step]), folded, folded == root))
    return sorted(out, key=repr)


def proven(df):
    parts = [F.replace(c, F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in mm.COLUMNS]
    later = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, mm.leaf_hash(*parts))
    return mm.proofs(mm.manifest(mm.leaves(df, later)))


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = cases.rows(queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001"))
    assert got == plain([tuple(r) for r in docs.select(*mm.COLUMNS).collect()])
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_awkward_rows(spark):
    df = cases.documents(spark)
    want = plain([tuple(r) for r in df.select(*mm.COLUMNS).collect()])
    assert cases.rows(proven(df)) == want
    assert cases.rows(proven(cases.clashing(df).repartition(5))) == want
    empty = proven(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    lone = proven(df.where("doc_id = 1")).head()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == h() and lone.verified


def test_several_rounds_of_blocks(spark):
    """A source of more than one block, and more sources than a block holds."""
    rows = [(i, "hot" if i % 2 else f"s{i % 1600}", None, i, f"line\n{i % 7}") for i in range(3200)] + [(5, "hot", "x", None, "")] * 3 + [(None, None, None, None, None)] * 800
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(11)
    assert cases.rows(proven(df)) == plain(rows)


def test_append_rebuilds_open_blocks_only(spark):
    def some(lo, hi):
        rows = [(i, None if i % 5 == 0 else "b" if i % 2 else f"c{i % 3}", "en", 1, f"t{i}") for i in range(lo, hi)]
        return mm.leaves(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))

    whole, first = mm.manifest(some(0, 4000)), mm.manifest(some(0, 2500))
    twice = mm.append(first, some(2500, 4000))
    assert cases.rows(twice.select("known", "name", "block", "n", "digest")) == cases.rows(whole.select("known", "name", "block", "n", "digest"))
    assert cases.rows(mm.proofs(twice)) == cases.rows(mm.proofs(whole))
    # A witness only grows: what an earlier leaf had within its source is kept, level by level, as later siblings come.
    old = {(r.doc_id): r.path for r in mm.witnesses(first).collect()}
    new = {(r.doc_id): r.path for r in mm.witnesses(twice).collect()}
    assert all(a.left == b.left and b.right.startswith(a.right) for i, path in old.items() for a, b in list(zip(path, new[i]))[:1])


@given(st.integers(1, 120))
@settings(max_examples=60, deadline=None)
def test_appended_nodes_get_the_witnesses_of_the_tree(n):
    digests = [h(str(i)) for i in range(n)]
    block, nodes = mm.grown(digests, n)
    root, steps = tree(digests)
    assert block.root.digest == root
    assert [mm.witness(x, []) for x in nodes] == steps
    assert all(mm.fold(d, s) == root for d, s in zip(digests, steps, strict=True))
