"""Chat formatting over a prefix tree: shared initial turns are emitted once, depth first, with positions and attention.

A turn is written as ``### role:`` LF text LF ``</turn>`` LF. Control strings inside texts and roles (the header mark, the
end mark, the backslash itself) get a backslash in front, so the format can be read back exactly. Code points serve as
tokens; a tokenizer's lengths may be put in their place.

1. A node is a distinct sequence of turns from the start, named by a chained digest of roles and texts, so conversations
   that share initial turns share nodes, however many they are.
2. A path of nodes ends in a leaf. Leaves sorted by their paths are the depth-first order of the tree: a node is emitted
   with the first leaf below it. Where a leaf's own nodes begin follows from prefix sums over the sorted leaves: range
   partitions, a running sum within each, and the sums of the partitions before it. No task holds a tree.
3. A node's tokens have the positions that they have in their conversation (tokens of the ancestors come before), and may
   attend to the intervals of the emitted stream that hold its ancestors, and causally to itself. Intervals that touch are
   united, so the first path of a tree has one interval, and each branching adds one at most.

Defined results: rows of a conversation are ordered by turn, role and text, so repeated rows are further turns; a null
text or role is empty; a null conv_id is one conversation; a null turn comes first. An empty table gives no nodes.
Further columns are not looked at. A conversation is one row of its turns in one task; trees are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import fields, saved, structs

HEAD, END, ESCAPE, LEARNT = "###", "</turn>", "\\", "assistant"
CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ((?:[^\\:]|\\.)*):\n((?:[^\\<]|\\.|<(?!/turn>))*)\n</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its text begins and ends."""
    head, body = f"{HEAD} {escape(role)}:\n", escape(text)
    return f"{head}{body}\n{END}\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


STEPS = "conv_id long, leaf binary, path binary, depth int, node binary, parent binary, role string, text string, n_tokens long, loss_from int, loss_to int, position long"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STEPS.split(", ")]
    for batch in batches:
        for conv, turns in zip(*batch.columns, strict=True):
            rows, node, path, position = [], b"", [], 0
            for depth, turn in enumerate(turns.as_py()):
                role, said = turn["role"] or "", turn["text"] or ""
                text, a, b = format_turn(role, said)
                parent, node = node, hashlib.blake2b(b"\0".join([node, role.encode("utf-8", "surrogatepass"), said.encode("utf-8", "surrogatepass")]), digest_size=16).digest()
                path.append(node)
                learnt = role == LEARNT
                rows.append([depth, node, parent or None, role, text, len(text), a if learnt else 0, b if learnt else 0, position])
                position += len(text)
            columns = [[conv.as_py()] * len(rows), [node] * len(rows), [b"".join(path)] + [None] * (len(rows) - 1), *map(list, zip(*rows, strict=True))]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def steps(turns: DataFrame) -> DataFrame:
    """A row per conversation and turn: the node it stands for, its conversation's leaf, and on the first turn the whole path."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return saved(convs.mapInArrow(_walk, STEPS))


def _attend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    for batch in batches:
        for path in batch.column(0):
            seen, names, lists = [], [], []
            for span in path.as_py():
                a, b = span["emit_start"], span["emit_start"] + span["n_tokens"]
                if seen and seen[-1]["to"] == a:
                    seen[-1] = {"from": seen[-1]["from"], "to": b}
                else:
                    seen.append({"from": a, "to": b})
                if span["own"]:
                    names.append(span["node"])
                    lists.append(list(seen))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(lists, kind)], names=["node", "attend"])


def nodes(steps: DataFrame) -> DataFrame:
    """The tree's nodes: what is emitted, where, its positions and what it attends to.

    Columns: node, parent, depth, role, text, n_tokens, loss_from, loss_to (code points of text under the loss mask),
    position (of its first token), emit_start, n_conversations, attend (array of from, to in the emitted stream, the end
    exclusive, its own tokens last).
    """
    # Leaves in path order: ranges of them, numbered within each. A place orders leaves as their paths do.
    leaves = steps.where("depth = 0").groupBy("leaf").agg(F.first("path").alias("path"))
    ranged = saved(leaves.repartitionByRange("path").withColumn("part", F.spark_partition_id().cast("long")))
    number = F.row_number().over(Window.partitionBy("part").orderBy("path"))
    places = ranged.select("leaf", "part", (F.shiftleft("part", 40) + number).alias("place"))
    counts = steps.groupBy("node").agg(F.count("*").alias("n_conversations"), F.first(F.struct("parent", "depth", "role", "text", "n_tokens", "loss_from", "loss_to", "position")).alias("d"))
    on_path = saved(steps.select("leaf", "depth", "node").distinct().join(places, "leaf"))
    owners = on_path.groupBy("node").agg(F.min("place").alias("place"))
    own = saved(counts.join(owners, "node").select("node", "d.*", "n_conversations", "place"))

    # Tokens that each leaf emits, and where they begin: running sums in each range, after the sums of the ranges before.
    emitted = own.groupBy("place").agg(F.sum("n_tokens").alias("tokens"), F.min("position").alias("first_position")).withColumn("part", F.shiftright("place", 40))
    in_parts = emitted.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = in_parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    running = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begins = emitted.withColumn("within", F.coalesce(F.sum("tokens").over(running), F.lit(0))).join(starts, "part").select("place", "first_position", (F.col("before") + F.col("within")).alias("begin"))
    placed = saved(own.join(begins, "place").withColumn("emit_start", F.col("begin") + F.col("position") - F.col("first_position")).drop("begin", "first_position"))

    # A leaf's path in one row: its nodes attend to those before them, wherever these were emitted.
    spans = on_path.select("place", "node").join(placed.select("node", "depth", "emit_start", "n_tokens", F.col("place").alias("owner")), "node")
    paths = spans.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("depth", "emit_start", "n_tokens", "node", (F.col("owner") == F.col("place")).alias("own")))).alias("path"))
    attend = paths.select("path").mapInArrow(_attend, "node binary, attend array<struct<from: bigint, to: bigint>>")
    return placed.join(attend, "node").select("node", "parent", "depth", "role", "text", "n_tokens", "loss_from", "loss_to", "position", "emit_start", "n_conversations", "attend")


def _digest(parts: list[str]) -> tuple[int, str]:
    joined = "".join(parts)
    return len(joined), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest()


@F.arrow_udf(fields(n_turns=T.LongType(), turns_sha256=T.StringType(), loss_chars=T.LongType(), loss_sha256=T.StringType(), formatted_chars=T.LongType()))
def read_back(column: pa.Array) -> pa.Array:
    """Digests of conversations read back from their emitted nodes (arrays of depth, text, loss_from, loss_to)."""
    out: list[list] = [[] for _ in range(5)]
    for path in column:
        path = path.as_py()
        formatted = "".join(n["text"] for n in path)
        turns = read_turns(formatted)
        masked = [unescape(n["text"][n["loss_from"]:n["loss_to"]]) for n in path]
        loss_chars, loss = _digest(masked)
        for values, value in zip(out, (len(turns), _digest([f"{role}\n{text}\n" for role, text in turns])[1], loss_chars, loss, len(formatted)), strict=True):
            values.append(value)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return structs(dict(zip(("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"), zip(out, kinds, strict=True), strict=True)))


def conversations(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id and digests, read back from the emitted nodes: each distinct path once, then its conversations."""
    paths = steps.select("leaf", "depth", "node").distinct()
    emitted = paths.join(nodes.select("node", "text", "loss_from", "loss_to"), "node")
    read = emitted.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "loss_from", "loss_to"))).alias("path")).select("leaf", read_back("path").alias("r")).select("leaf", "r.*")
    return steps.where("depth = 0").select("conv_id", "leaf").join(read, "leaf").drop("leaf")
