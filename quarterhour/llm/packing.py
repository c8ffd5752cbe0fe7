"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

1. Each document becomes token ids plus an end id. It is cut into pieces of at most ``length`` ids, so all pieces but the
   last are full sequences. Only (key, start, length, checksum) leaves the tokenizer, not the ids.
2. Documents are dealt at random into groups of about ``per_group`` documents. The random key is stored with the pieces
   (checkpoint), so a task that runs again after a lost executor sees the same groups. A group's size does not depend on
   keys or texts, so neither repeated rows nor a hot source make a large group.
3. In each group pieces are placed longest first, each into the first sequence with room. The tournament tree holds the
   room of every open sequence; an inner node holds the larger room below it, so the first fit is found in log time.

Defined results: a null or empty text is its end id alone (one piece of length 1). Rows with null or repeated doc_id are
packed like others, each row for itself. An empty table gives no sequences. Further columns are not looked at.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterhour.llm.common import records, saved

LENGTH, END_ID, PER_GROUP = 2048, 1, 4096
RANKS, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}
KEPT_PARTS, KEPT_CHARS = 400_000, 64
#: A word of this pre-tokenizer takes one space in front of it, so a run of spaces and line feeds that follows another
#: character always begins a word. A text with other white space is encoded whole.
PART, UNSAFE = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall, re.compile(r"[^\S \n]").search


class _Parts(dict):
    """Part of a text -> its ids as bytes; filled as parts come up."""

    def __init__(self, encoding: tiktoken.Encoding):
        self.encode = encoding.encode_ordinary

    def __missing__(self, part: str) -> bytes:
        ids = array.array("I", self.encode(part)).tobytes()
        if len(part) <= KEPT_CHARS:
            if len(self) >= KEPT_PARTS:
                self.clear()
            self[part] = ids
        return ids


@lru_cache(maxsize=2)
def _parts(path: str) -> _Parts:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return _Parts(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def token_bytes(text: str, parts: _Parts) -> bytes:
    """The ids of a text as 32-bit numbers; the special strings stand for their own ids, as in the tokenizer file."""
    out = []
    for i, piece in enumerate(re.split("(" + "|".join(map(re.escape, SPECIAL)) + ")", text) if "<|" in text else [text]):
        if i % 2:
            out.append(array.array("I", [SPECIAL[piece]]).tobytes())
        elif UNSAFE(piece):
            out.append(array.array("I", parts.encode(piece)).tobytes())
        else:
            out += map(parts.__getitem__, PART(piece))
    return b"".join(out)


def pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, start, length, ids_crc32, doc_tokens, and the row's place ``part``, ``row``."""
    end = array.array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = _parts(public_tokenizers.path(ranks)), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = token_bytes(text.as_py() or "", known) + end
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at:at + 4 * length]
                    for column, value in zip(out, (doc.as_py(), at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, row), strict=True):
                        column.append(value)
                row += 1
            yield records(dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"), ((c, pa.int64()) for c in out), strict=True)))

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")
    return made.withColumn("part", F.spark_partition_id())


class Rooms:
    """Tournament tree over the room of sequences 0..n-1."""

    def __init__(self, n: int, room: int):
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """Take ``need`` from the first sequence that has it."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        tree[node] -= need
        found = node - self.leaves
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece; pieces of equal length are placed in the order given."""
    rooms, used = Rooms(len(lengths), capacity), {}
    number, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        number[i] = n = rooms.first_fit(lengths[i])
        offset[i] = used.get(n, 0)
        used[n] = offset[i] + lengths[i]
    return number, offset


def packed(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, per_group: int = PER_GROUP, **columns) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding.

    ``padding`` is what its sequence lacks to ``length``, 0 where the sequence's length is a power of two.
    """
    # The row's place makes a key that differs for repeated rows, and the checkpoint keeps it, whatever runs again.
    dealt = F.xxhash64("part", "row", "doc_id")
    made = saved(pieces(docs, length, end_id, **columns).withColumn("key", dealt))
    n = made.where("start = 0").count()
    groups = max(1, -(-n // per_group))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "start"], kind="stable")
        number, offset = first_fit_decreasing(group["length"].tolist(), length)
        group["sequence_id"] = group["grp"] * 2**32 + number
        group["offset"] = offset
        total = group.groupby("sequence_id")["length"].transform("sum")
        group["padding"] = (length - total).where(total & (total - 1) != 0, 0)
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]]

    schema = ", ".join(f"{c} long" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"))
    grouped = made.withColumn("grp", F.pmod(F.col("key"), F.lit(groups)).cast("long")).drop("part", "row")
    return grouped.groupBy("grp").applyInPandas(pack, schema)
