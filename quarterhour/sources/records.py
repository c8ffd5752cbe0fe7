"""A create-only store of records whose appends read only what may hold their ids.

Each append is a batch, laid out by a prefix of the id's hash, and comes with a Bloom filter per prefix: 32 bits an id, 8 of them
set, kept as rows (batch, prefix, word, bits). An append looks its ids up in the filters, an equality join on word; an id all
of whose bits are set in a batch may be there, about one in 200,000 that is not. Only the (batch, prefix) folders so named are
read, and only their ids, and an anti-join on them settles which ids are there. So the result is exact, and the cost of an
append follows its own size and what it repeats, not the size of the store.

A batch counts once its entry in ``log`` is written, after its records and filter: what a failed append left is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterhour.sources.stage import children, shared

PREFIX_BITS, BITS_PER_ID, SET_BITS = 8, 32, 8


@dataclass(frozen=True)
class Append:
    """What an append did: its batch (None if nothing was new), rows stored, and the folders that were read for it."""

    batch: int | None
    stored: int
    read: tuple[tuple[int, int], ...]


def prefix_of(record: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(0), record), 64 - PREFIX_BITS).cast("int")


def positions(record: Column, words: Column) -> Column:
    """The bits of an id, as (word, bit) in a filter of ``words`` words."""
    def one(i: int) -> Column:
        h = F.xxhash64(F.lit(i + 1), record)
        return F.struct(F.pmod(F.shiftrightunsigned(h, 6), words).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("bit"))

    return F.array(*[one(i) for i in range(SET_BITS)])


class RecordStore:
    def __init__(self, spark: SparkSession, path: str, id_col: str = "record_id"):
        self.spark, self.path, self.id_col = spark, path, id_col

    def batches(self) -> dict[int, int]:
        """Complete batches and the words of their filters."""
        if not children(self.spark, f"{self.path}/log"):
            return {}
        return {r.batch: r.words for r in self.spark.read.schema("batch int, words long").parquet(f"{self.path}/log").collect()}  # one row per append

    def _records(self, batches: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/records").parquet(*[f"{self.path}/records/batch={b}" for b in batches])

    def read(self) -> DataFrame:
        known = self.batches()
        if not known:
            raise ValueError("the store has no batch yet")
        return self._records(sorted(known)).drop("batch", "prefix")

    def maybe_stored(self, ids: DataFrame, known: dict[int, int]) -> DataFrame:
        """batch, prefix, id: where the filters cannot rule an id out. ``ids``: id, prefix."""
        filters = self.spark.read.option("basePath", f"{self.path}/filters").parquet(*[f"{self.path}/filters/batch={b}" for b in sorted(known)])
        sizes = F.explode(F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(w).cast("long").alias("words")) for b, w in sorted(known.items())]))
        asked = ids.select("id", "prefix", sizes.alias("s")).select("id", "prefix", "s.batch", F.explode(positions(F.col("id"), F.col("s.words"))).alias("p")).select("id", "prefix", "batch", "p.word", "p.bit")
        hit = asked.join(filters, ["batch", "prefix", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return hit.groupBy("batch", "prefix", "id").agg(F.count("*").alias("n")).where(F.col("n") == SET_BITS).drop("n")

    def append(self, df: DataFrame) -> Append:
        """Store the records whose id is not stored yet; an id that comes twice is stored once, a null id never."""
        new = shared(df.where(F.col(self.id_col).isNotNull()).dropDuplicates([self.id_col]).withColumn("prefix", prefix_of(F.col(self.id_col).cast("string"))))
        known, read = self.batches(), []
        if known:
            ids = new.select(F.col(self.id_col).cast("string").alias("id"), "prefix")
            maybe = shared(self.maybe_stored(ids, known))
            read = [(r.batch, r.prefix) for r in maybe.select("batch", "prefix").distinct().orderBy("batch", "prefix").collect()]  # folders, not ids
            if read:
                folder = F.concat_ws("/", F.col("batch").cast("string"), F.col("prefix").cast("string"))
                there = self._records(sorted({b for b, _ in read})).where(folder.isin([f"{b}/{p}" for b, p in read])).select(F.col(self.id_col).alias("_id"))
                new = shared(new.join(there, F.col(self.id_col) == F.col("_id"), "left_anti"))
        rows = new.count()
        if not rows:
            return Append(None, 0, tuple(read))
        batch = max([int(c.partition("=")[2]) for c in children(self.spark, f"{self.path}/records") if c.startswith("batch=")], default=0) + 1
        words = max(16, rows * BITS_PER_ID // 64 >> PREFIX_BITS)
        bits = new.select("prefix", F.explode(positions(F.col(self.id_col).cast("string"), F.lit(words))).alias("p")).groupBy("prefix", "p.word").agg(F.bit_or("p.bit").alias("bits"))
        new.repartition("prefix").write.mode("error").partitionBy("prefix").parquet(f"{self.path}/records/batch={batch}")
        bits.write.mode("error").parquet(f"{self.path}/filters/batch={batch}")
        self.spark.createDataFrame([(batch, words)], "batch int, words long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return Append(batch, rows, tuple(read))
