"""Near-duplicate documents: MinHash bands propose pairs, odd sketches filter them, full shingle sets confirm them.

A document's set holds its distinct shingles of five words (A-Z lower-cased); with fewer words, the whole sequence as one.
Two documents are linked if 100 * intersection >= 85 * union, and a group is what links connect.

1. One pass over the texts: set size, digest of the set, 252 MinHash samples as 36 bands of 7, and the odd sketch: each
   sample flips one bit of a 512-bit map, so bits of the XOR of two maps are odd where samples differ, and their number
   estimates a high similarity closely.
2. Documents with equal sets become one node. Nodes that share a band are candidates; at 0.85 similarity a pair shares
   none of the 36 bands once in 10^6.
3. Not all pairs of a bucket are formed. In each bucket one node, the one with the most neighbours over all bands (the
   original of a family of copies agrees with most of them), is paired with the others: as many pairs as rows. Confirmed
   links give first groups. Only pairs of the same bucket in different groups are left. Their nodes get a finer odd sketch
   (2048 samples on 4096 bits), which tells 0.85 from what lies within a family of copies; size and both sketches must
   allow a pair, and it comes from its smallest common band alone, so once.
4. Links are confirmed on full sets, and groups follow by alternating large-star and small-star steps on the links.

Every pair that shares a band is either confirmed, refused by size (exact) or sketch, or already connected: there is no
cap on buckets, candidates or partners. The sketches refuse pairs estimated under 0.72 and, the finer one, under 0.80:
more than four standard errors below 0.85.

Defined results: without words (null or empty text) a document has set size 0, is linked with nothing and kept. Rows with
the same doc_id count as one document: an id with different texts connects the groups of all of them. A null doc_id is linked with nothing: its
component is null, and it is kept. An empty table gives no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterhour.llm.common import saved

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 36, 7
SAMPLES, SKETCH_BITS, SKETCH_FLOOR = BANDS * ROWS, 512, 0.72
FINE_SAMPLES, FINE_BITS, FINE_FLOOR = 2048, 4096, 0.80
BLOCK, CHUNK = 1 << 20, 512


def most_odd(samples: int, bits: int, floor: float) -> int:
    """Odd bits expected at the similarity ``floor``: with more, two sketches are not looked at further."""
    return int(bits / 2 * (1 - math.exp(-4 * samples * (1 - floor) / bits)))


MOST_ODD, FINE_ODD = most_odd(SAMPLES, SKETCH_BITS, SKETCH_FLOOR), most_odd(FINE_SAMPLES, FINE_BITS, FINE_FLOOR)

_random = np.random.default_rng(20240229)
BYTE = _random.integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
FLIP, TIMES = _random.integers(0, 2**32, FINE_SAMPLES, np.uint32), _random.integers(0, 2**32, FINE_SAMPLES, np.uint32) | np.uint32(1)
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))])
    return _powers


def blocks(data: bytes) -> Iterator[bytes]:
    """Parts of about a megabyte that end where a word ends."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, read off running sums over the block."""
    out = []
    for block in blocks(data.lower()):  # of bytes: A-Z only
        b = np.frombuffer(block, np.uint8)
        edge = np.diff(np.concatenate([[0], (~SPACE[b]).view(np.int8), [0]]))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(b) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up[:len(b)])])
        out.append(mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The set of shingle hashes, ascending."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    n = min(size, len(words))
    if not n:
        return words
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mixed(h * BASE + words[i:len(words) - n + 1 + i])
    return np.unique(h)


def samples(hashes: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """MinHash samples of a set; the first ones are the same for every count."""
    short = (mixed(hashes + BASE) >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(short), CHUNK):
        least = np.minimum(least, ((short[at:at + CHUNK][None, :] ^ FLIP[:count, None]) * TIMES[:count, None]).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * BASE + rows[:, i])
    return key.view(np.int64)


def odd_sketch(least: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of how many samples fall on each bit, as 64-bit numbers."""
    place = mixed(least.astype(np.uint64) * BASE + np.arange(len(least), dtype=np.uint64)) >> np.uint64(65 - bits.bit_length())
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits).astype(np.uint8) & 1).view(np.int64)


def odd_bits(a: Column, b: Column, bits: int = SKETCH_BITS) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, bits // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def set_digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), pa.int64()))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = np.zeros(0, np.int64)
    for batch in batches:
        sizes, digests, keys, sketches = [], [], [], []
        for text in batch.column(1):
            own = shingles(text.as_py() or "")
            least = samples(own) if len(own) else none
            sizes.append(len(own))
            digests.append(set_digest(own))
            keys.append(bands(least) if len(own) else none)
            sketches.append(odd_sketch(least) if len(own) else none)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(keys), _lists(sketches)], names=["doc_id", "n_shingles", "digest", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest, bands, sketch of each row of (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_signed, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def _finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text.as_py() or "") for text in batch.column(1)]
        digests = [set_digest(own) for own in sets]
        sketches = _lists([odd_sketch(samples(own, FINE_SAMPLES), FINE_BITS) for own in sets])
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), sketches], names=["digest", "fine"])


def fine_sketches(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """digest, fine: the finer sketch of the sets of the documents in ``ids`` (doc_id)."""
    return docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_finely, "digest binary, fine array<long>").dropDuplicates(["digest"])


def similar(n_a: Column, n_b: Column) -> Column:
    """Sizes that allow a link: the intersection is the smaller set at most."""
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, own = None, None
    for batch in batches:
        a, b = [], []
        for doc_a, digest_a, text_a, doc_b, digest_b, text_b in zip(*[c for c in batch.columns], strict=True):
            if (key := (doc_a.as_py(), text_a.as_py())) != at:  # the rows come sorted by the first document
                at, own = key, shingles(key[1] or "")
                own_digest = set_digest(own)
            other = shingles(text_b.as_py() or "")
            if own_digest != digest_a.as_py() or set_digest(other) != digest_b.as_py():
                continue  # another row with the same doc_id
            both = len(np.intersect1d(own, other, assume_unique=True))
            if 100 * both >= PERCENT * (len(own) + len(other) - both):
                a.append(key[0])
                b.append(doc_b.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, digest_a, b, digest_b) that are links by their full sets, as (a, b)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    needed = docs.join(ids, "doc_id", "left_semi")
    of = lambda side: needed.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").select("a", "digest_a", "text_a", "b", "digest_b", "text_b")
    return both.mapInArrow(_confirm, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each node's component, by alternating large-star and small-star steps."""
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            around = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("least"))
        moved = around.join(least, "a")
        if large:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
        return moved.where("a <> b").distinct()

    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(2**31))).first()
    edges = saved(edges.where("a <> b").distinct())
    before, now = None, mark(edges)
    while now != before:
        edges = saved(stars(stars(edges, large=True), large=False))
        before, now = now, mark(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = saved(signatures(docs))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    nodes = signed.join(classes, ["digest"]).where("doc_id = rep").dropDuplicates(["digest"]).select("rep", "digest", "n_shingles", "bands", "sketch")

    keyed = nodes.select("rep", "digest", F.explode("bands").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    own = keyed.join(met, "key").groupBy("digest").agg(F.collect_set("key").alias("keys"), F.sum("met").alias("degree"))
    rows = saved(nodes.join(own, "digest").select("rep", "digest", "n_shingles", "sketch", "keys", "degree").select("*", F.explode("keys").alias("key")))

    # In each bucket the node with the highest degree against the others.
    fields = ["rep", "digest", "n_shingles", "sketch"]
    hubs = rows.groupBy("key").agg(F.max_by(F.struct(*fields), F.struct("degree", -F.col("rep"), "digest")).alias("hub"))
    allowed = lambda a, b: similar(a["n_shingles"], b["n_shingles"]) & (odd_bits(a["sketch"], b["sketch"]) <= MOST_ODD)
    ordered = lambda a, b: [F.least(a["rep"], b["rep"]).alias("a"), F.when(a["rep"] < b["rep"], a["digest"]).otherwise(b["digest"]).alias("digest_a"), F.greatest(a["rep"], b["rep"]).alias("b"), F.when(a["rep"] < b["rep"], b["digest"]).otherwise(a["digest"]).alias("digest_b")]
    spoke, hub = F.struct(*fields), F.col("hub")
    met_hub = rows.join(hubs, "key").select(spoke.alias("spoke"), "hub").where(F.col("spoke.rep") != F.col("hub.rep"))
    first_pairs = saved(met_hub.where(allowed(F.col("spoke"), hub)).select(*ordered(F.col("spoke"), hub)).distinct())
    first_links = saved(confirmed(first_pairs, docs))
    groups = connected(first_links)

    # Pairs of a bucket in different groups, each from its smallest common key.
    labelled = rows.join(groups, F.col("rep") == F.col("node"), "left").select(*fields, "keys", "key", F.coalesce("label", "rep").alias("label"))
    mixed_buckets = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = saved(labelled.join(mixed_buckets, "key", "left_semi"))
    fine = fine_sketches(left.select(F.col("rep").alias("doc_id")).distinct(), docs)
    open_rows = saved(left.join(fine, "digest"))
    x, y = open_rows.alias("x"), open_rows.alias("y")
    side = lambda name: {c: F.col(f"{name}.{c}") for c in [*fields, "keys", "key", "label", "fine"]}
    a, b = side("x"), side("y")
    once = F.array_min(F.array_intersect(a["keys"], b["keys"])) == a["key"]
    rest = x.join(y, (a["key"] == b["key"]) & (a["rep"] < b["rep"]) & (a["label"] != b["label"]) & allowed(a, b) & (odd_bits(a["fine"], b["fine"], FINE_BITS) <= FINE_ODD) & once).select(*ordered(a, b))
    more_links = confirmed(saved(rest.join(first_pairs, ["a", "digest_a", "b", "digest_b"], "left_anti")), docs)

    # An id with different sets connects what they are in.
    set_hash = F.xxhash64("digest")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(set_hash).alias("low"), F.max(set_hash).alias("high")).where("low <> high").select("doc_id")
    same_id = signed.select("doc_id", "digest").join(several, "doc_id", "left_semi").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    labels = connected(first_links.union(more_links).union(same_id))

    placed = signed.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").withColumn("own", F.coalesce("rep", "doc_id")).join(labels, F.col("own") == F.col("node"), "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "own")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
