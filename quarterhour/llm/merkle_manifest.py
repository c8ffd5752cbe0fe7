"""Merkle manifest of a dataset, with incremental witnesses.

Every row is a leaf: the SHA-256 of its columns, each with its length. A source's leaves in order of id form a tree of runs of
three, and the sources' roots form one more such tree, whose root stands for the dataset.

1. Leaves are hashed where the rows are read, and only digests and ids are shuffled. Range partitions with offsets give
   each leaf its position within its source, so no task holds a source, not even one with a third of all rows.
2. A block is 729 consecutive leaves, aligned at multiples of 729. Within it leaves are appended one after the other. An
   appended node meets the open run of its level: its witness starts with the siblings already there, and their witnesses
   are extended by it. A full run closes into its parent, which is appended a level higher in the same way.
3. Block roots are appended in turn, in blocks of 729 block roots, until a source has one node left; then the roots of the
   sources are. A leaf's witness is that within its block, continued by that of its block root, and so on up.

A block that is full never changes, so ``append`` adds rows to a stored manifest by rebuilding the open block of each source
they belong to; witnesses of earlier leaves are extended by the blocks that come to stand beside theirs.

Defined results: a null is written ``-``, unlike the empty text ``0:``. A null source is a source of its own, the first; a
null id comes first in its source. Rows with one id are in order of their leaves, so rows alike get proofs at places of
their own, in no particular order among them. Texts are hashed whole. An empty table has no rows and no root. Columns
other than the hashed ones are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import fields, saved

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, LEVELS = 3, 6
WIDTH = RUN**LEVELS
TREE = ["known", "name"]
STEP = fields(left=T.StringType(), right=T.StringType())
PATH = T.ArrayType(STEP)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Node:
    """A subtree's root: its digest, the siblings its witness has so far, and its parent once its run is closed."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, value: str, left: str):
        self.digest, self.left, self.right, self.parent = value, left, "", None


class Block:
    """A tree that grows by appended nodes; ``levels`` is its height, at which a node is the root."""

    def __init__(self, levels: int):
        self.open: list[list[Node]] = [[] for _ in range(levels)]
        self.root: Node | None = None

    def append(self, value: str, level: int = 0) -> Node:
        if level == len(self.open):
            self.root = Node(value, "")
            return self.root
        run = self.open[level]
        node = Node(value, "".join(s.digest for s in run))
        for sibling in run:
            sibling.right += value
        run.append(node)
        if len(run) == RUN:
            self.close(level)
        return node

    def close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = self.append(digest(*[s.digest for s in run]), level + 1)
        for sibling in run:
            sibling.parent = parent

    def finish(self) -> None:
        for level in range(len(self.open)):
            if self.open[level]:
                self.close(level)


def grown(digests: list[str], n: int) -> tuple[Block, list[Node]]:
    """The block of these nodes, out of ``n`` in their tree. Only a tree's single block may be lower than LEVELS."""
    levels = 0
    while levels < LEVELS and RUN**levels < n:
        levels += 1
    block = Block(levels)
    nodes = [block.append(d) for d in digests]
    block.finish()
    return block, nodes


def witness(node: Node, above: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Siblings to the left and to the right, level by level, up to the dataset's root."""
    steps = []
    while node.parent is not None:
        steps.append((node.left, node.right))
        node = node.parent
    return steps + above


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness give."""
    for left, right in steps:
        leaf = digest(left, leaf, right)
    return leaf


def proof(steps: list[tuple[str, str]]) -> str:
    return digest(*chain.from_iterable(steps))


def _above(path: list[dict]) -> list[tuple[str, str]]:
    return [(s["left"], s["right"]) for s in path]


@F.arrow_udf(T.StringType())
def _block_root(digests: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([grown(d, k)[0].root.digest for d, k in zip(digests.to_pylist(), n.to_pylist(), strict=True)], pa.string())


@F.arrow_udf(T.ArrayType(PATH))
def _witnesses(digests: pa.Array, n: pa.Array, path: pa.Array) -> pa.Array:
    step = pa.struct([("left", pa.string()), ("right", pa.string())])
    out = []
    for d, k, p in zip(digests, n, path, strict=True):
        above = _above(p.as_py())
        out.append([[{"left": a, "right": b} for a, b in witness(node, above)] for node in grown(d.as_py(), k.as_py())[1]])
    return pa.array(out, pa.list_(pa.list_(step)))


@F.arrow_udf(T.ArrayType(fields(proof_sha256=T.StringType(), folded_root=T.StringType())))
def _proofs(digests: pa.Array, changed: pa.Array, n: pa.Array, path: pa.Array) -> pa.Array:
    out = []
    for d, c, k, p in zip(digests, changed, n, path, strict=True):
        above, own = _above(p.as_py()), d.as_py()
        steps = [witness(node, above) for node in grown(own, k.as_py())[1]]
        out.append([{"proof_sha256": proof(s), "folded_root": fold(new or old, s)} for s, old, new in zip(steps, own, c.as_py(), strict=True)])
    return pa.array(out, pa.list_(pa.struct([("proof_sha256", pa.string()), ("folded_root", pa.string())])))


def leaf_hash(*columns: Column) -> Column:
    """SHA-256 in hex of the columns, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value."""
    values = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]).cast("binary"), 256)


def leaves(docs: DataFrame, later: Column | None = None, columns=COLUMNS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """known, name (the source), doc_id, digest, and changed: the leaf of the row's later state, null if that is the same.

    ``later`` gives the leaf hash of what the row holds when it is verified; null, or no column at all, is what it holds now.
    """
    own = leaf_hash(*[F.col(c) for c in columns])
    rows = docs.select(F.col(source_col).isNotNull().alias("known"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), F.col(id_col).alias("doc_id"),
                       own.alias("digest"), (F.lit(None).cast("string") if later is None else later).alias("changed"))
    return rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds position (from 0, by ``order`` within ``keys``) and n (rows of the keys)."""
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())  # rows alike are spread over partitions too
    by = [*[F.col(c) for c in keys], *[F.col(c).asc_nulls_first() for c in order], F.col("tie")]
    ordered = saved(ranged.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    runs = ordered.groupBy(*keys, "part").agg(F.min("at").alias("first_at"), F.count("*").alias("rows"))
    whole = Window.partitionBy(*keys)
    offsets = runs.withColumn("n", F.sum("rows").over(whole)).withColumn("before", F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).drop("rows")
    return ordered.join(offsets, [*keys, "part"]).withColumn("position", F.col("at") - F.col("first_at") + F.col("before")).drop("at", "part", "first_at", "before")


def blocks(nodes: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """known, name, block, n, entries (position, digest and payload in order) and digest, the block's root."""
    entry = F.struct("position", "digest", *payload)
    grouped = nodes.groupBy(*TREE, F.floor(F.col("position") / WIDTH).cast("long").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return grouped.withColumn("digest", _block_root("entries.digest", "n"))


def rounds(first: DataFrame) -> list[DataFrame]:
    """The blocks of leaves, the blocks of their roots, and so on; a source ends in the round in which it has one block."""
    found = [first]
    while (most := found[-1].agg(F.max("n")).head()[0]) is not None and most > WIDTH:
        upper = found[-1].where(F.col("n") > WIDTH).select(*TREE, F.col("block").alias("position"), "digest", F.ceil(F.col("n") / WIDTH).cast("long").alias("n"))
        found.append(saved(blocks(upper)))
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """known, name, subroot: one row per source."""
    ends = [r.where(F.col("n") <= WIDTH).select(*TREE, F.col("digest").alias("subroot")) for r in found]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def paths(found: list[DataFrame], tops: DataFrame) -> DataFrame:
    """known, name, block, path: the witness of each block of leaves. ``tops``: known, name, path of the sources."""
    below = None
    for r in range(len(found) - 1, -1, -1):
        own = found[r].where(F.col("n") <= WIDTH).select(*TREE, "block").join(tops, TREE)
        here = own.select(*TREE, "block", "path") if below is None else own.select(*TREE, "block", "path").union(below)
        if r:
            w = found[r].join(here, [*TREE, "block"]).select(*TREE, "entries", _witnesses("entries.digest", "n", "path").alias("steps"))
            below = w.select(*TREE, F.explode(F.arrays_zip("entries", "steps")).alias("e")).select(*TREE, F.col("e.entries.position").alias("block"), F.col("e.steps").alias("path"))
    return here


def manifest(rows: DataFrame) -> DataFrame:
    """The blocks of the leaves that ``leaves`` gives, to be stored or proven."""
    return saved(blocks(placed(rows, TREE, ["doc_id", "digest"]), ("doc_id", "changed")))


def append(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The manifest with further leaves, each after all earlier ones of its source. Full blocks are taken over as they are."""
    lengths = stored.groupBy(*TREE).agg(F.max("n").alias("had"))
    fresh = placed(rows, TREE, ["doc_id", "digest"]).withColumnRenamed("n", "more").join(lengths, TREE, "left").fillna(0, ["had"])
    fresh = fresh.withColumn("position", F.col("position") + F.col("had")).withColumn("n", F.col("had") + F.col("more")).drop("had", "more")
    totals = fresh.groupBy(*TREE).agg(F.max("n").alias("now"))
    kept = stored.join(totals, TREE, "left").withColumn("n", F.coalesce("now", "n")).withColumn("reopened", F.col("now").isNotNull() & (F.size("entries") < WIDTH)).drop("now")
    reopened = kept.where("reopened").select(*TREE, "n", F.explode("entries").alias("e")).select(*TREE, "n", "e.*")
    return saved(kept.where("not reopened").drop("reopened").unionByName(blocks(fresh.unionByName(reopened), ("doc_id", "changed"))))


def proofs(stored: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every leaf, with the digest of its witness and the root
    that its later state and the witness give."""
    found = rounds(stored)
    subroots = saved(roots(found))
    sources = placed(subroots.select(F.lit(True).alias("all"), "known", "name", F.col("subroot").alias("digest")), ["all"], TREE)
    tops = saved(blocks(sources.select(F.lit(True).alias("known"), F.lit("").alias("name"), "position", "n", "digest", F.struct("known", "name").alias("tree")), ("tree",)))
    upper = rounds(tops)
    root = roots(upper).select("subroot").head()  # one row at most
    over = paths(upper, upper[-1].select(*TREE).distinct().withColumn("path", F.array().cast(PATH)))
    per_source = tops.join(over, [*TREE, "block"]).select("entries", _witnesses("entries.digest", "n", "path").alias("steps"))
    per_source = per_source.select(F.explode(F.arrays_zip("entries", "steps")).alias("e")).select("e.entries.tree.*", F.col("e.steps").alias("path"))
    above = saved(paths(found, per_source)).join(subroots, TREE)
    judged = stored.select(*TREE, "block", "n", "entries").join(above, [*TREE, "block"])
    judged = judged.select("subroot", "entries", _proofs("entries.digest", "entries.changed", "n", "path").alias("p"))
    rows = judged.select("subroot", F.explode(F.arrays_zip("entries", "p")).alias("e"))
    whole = F.lit(root[0] if root else None).cast("string")
    return rows.select(F.col("e.entries.doc_id").alias("doc_id"), F.col("e.entries.digest").alias("leaf"), "subroot", whole.alias("root"), F.col("e.p.proof_sha256").alias("proof_sha256"), F.col("e.p.folded_root").alias("folded_root"),
                       (F.col("e.p.folded_root") == whole).alias("verified"))


def witnesses(stored: DataFrame) -> DataFrame:
    """known, name, doc_id, digest, path: every leaf with its siblings within its source, level by level."""
    found = rounds(stored)
    tops = roots(found).select(*TREE, F.array().cast(PATH).alias("path"))
    w = stored.join(paths(found, tops), [*TREE, "block"]).select(*TREE, "entries", _witnesses("entries.digest", "n", "path").alias("steps"))
    return w.select(*TREE, F.explode(F.arrays_zip("entries", "steps")).alias("e")).select(*TREE, "e.entries.doc_id", "e.entries.digest", F.col("e.steps").alias("path"))
