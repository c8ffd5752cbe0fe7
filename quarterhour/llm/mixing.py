"""Mixing sources to target weights, with DataFrame operations only.

1. Size per row and a hash-random key: the MD5 of seed, id, source and text. Its first three hex digits are the row's slice, so
   a slice is a range of keys and a source is 4096 ranges, however many rows it has.
2. Sums per (source, slice) form a small table. Target per source by filling up to the cap; epochs = target / source size.
3. Prefix sums in key order: the slice's offset (prefix sum over at most 4096 slices of a source) plus the prefix sum
   within the slice. Both windows end at a slice, so no task holds a source, not even one with a third of all rows.
4. Cut: each row is taken in every full epoch; in the last one it is taken as far as it lies below the exact budget.

Defined results: a null text has size 0 and takes nothing; a null source is one source, the last in order. Repeated rows
share a key and are taken one after the other. A table without words gives targets of 0. Further columns are not looked
at by ``mix``. Results do not depend on partitioning, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterhour.llm.common import WORD, saved

WEIGHTS, CAP, SEED, SLICE_DIGITS = (5, 2, 1), 3, 7, 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(seed: int, doc_id: Column, source: Column, text: Column) -> Column:
    """A key that looks random but is the same in every run; rows alike in id, source and text share it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source, text)]).cast("binary"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Words each source should give. ``sources``: mix_source, source_size; one row per source.

    Weights repeat over the sources in code point order, null last. The words of all sources are shared out by weight,
    and a source stops at ``cap`` times its size. A source is full exactly if its size per weight is small, so sources
    are put in that order: source i is full if, with those before it full and the rest shared by weight, its share
    reaches its cap. Running sums over one row per source decide it without repeating rounds.
    """
    place = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", weight).withColumn("most", (F.col("source_size") * cap).cast("double"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("mix_source").asc_nulls_last())
    upto, everything = by_fill.rowsBetween(Window.unboundedPreceding, 0), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words, all_weights = F.sum(F.col("source_size").cast("double")).over(everything), F.sum("weight").over(everything)
    before = weighed.withColumn("left_words", all_words - F.sum("most").over(upto) + F.col("most")).withColumn("left_weight", all_weights - F.sum("weight").over(upto) + F.col("weight"))
    fits = F.col("most") / F.col("weight") <= F.col("left_words") / F.col("left_weight")
    level = F.first(F.when(~fits, F.col("left_words") / F.col("left_weight")), ignorenulls=True).over(everything)
    return before.withColumn("target", F.when(fits, F.col("most")).otherwise(F.col("weight") * level)).select("mix_source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, and mix_key, mix_before (words of its source before it), full_epochs, last_words."""
    doc_id, source, text = F.col(id_col), F.col(source_col), F.col(text_col)
    sized = saved(docs.select(doc_id.alias("doc_id"), source.alias("mix_source"), word_count(text).alias("size"), hash_key(seed, doc_id, source, text).alias("mix_key")))
    sized = sized.withColumn("slice", F.substring("mix_key", 1, SLICE_DIGITS)).withColumn("known", F.col("mix_source").isNotNull()).withColumn("name", F.coalesce("mix_source", F.lit("")))
    keys = ["known", "name", "slice"]
    slices = sized.groupBy(*keys).agg(F.sum("size").alias("slice_size"), F.first("mix_source").alias("mix_source"))
    earlier = Window.partitionBy("known", "name").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("slice_before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    goals = targets(slices.groupBy("known", "name").agg(F.sum("slice_size").alias("source_size"), F.first("mix_source").alias("mix_source")), weights, cap)
    goals = goals.withColumn("known", F.col("mix_source").isNotNull()).withColumn("name", F.coalesce("mix_source", F.lit(""))).drop("mix_source")
    # Per slice, not per row: what is joined to the rows has one row for each (source, slice), so no join key is hot.
    plan = offsets.select(*keys, "slice_before").join(goals, ["known", "name"])
    in_slice = Window.partitionBy(*keys).orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("within", F.coalesce(F.sum("size").over(in_slice), F.lit(0))).join(plan, keys)
    budget = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    before = F.col("slice_before") + F.col("within")
    last = F.least(F.col("size"), F.greatest(F.lit(0), budget - full * F.col("source_size") - before)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", (full * F.col("size") + last).alias("taken"), "mix_key", before.alias("mix_before"), full.alias("full_epochs"), last.alias("last_words"))


def mixed(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: a row per epoch that takes it.

    A mix is made of whole documents, so the one that the last epoch's budget cuts stays if at least half of it fits.
    Rows that share a key share their copies evenly.
    """
    plan = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = F.col("full_epochs") + F.when((F.col("last_words") > 0) & (2 * F.col("last_words") >= F.col("size")), 1).otherwise(0)
    chosen = plan.groupBy("mix_key").agg(F.sum(copies).alias("copies"), F.count("*").alias("alike")).where("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), hash_key(seed, F.col(id_col), F.col(source_col), F.col(text_col)).alias("mix_key")).join(chosen, "mix_key")
    turn = F.row_number().over(Window.partitionBy("mix_key").orderBy("mix_key"))
    own = F.floor(F.col("copies") / F.col("alike")) + F.when(turn <= F.col("copies") % F.col("alike"), 1).otherwise(0)
    repeated = rows.withColumn("own", own.cast("int")).where("own > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("own"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
