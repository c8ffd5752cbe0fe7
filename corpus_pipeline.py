"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterhour.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from quarterhour.llm.common import saved, shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. A null or empty text has no words and goes; rows alike are judged alike; long texts are
    measured whole, other columns pass through, and an empty table stays empty."""
    row = F.struct(*docs.columns)
    judged = docs.select(row.alias("row"), quality_rules.ledger(docs["text"]).getField("bits").alias("bits"))
    kept = judged.where(~quality_rules.fails(F.col("bits"), quality_rules.POLICIES[quality_rules.CURRENT]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Where ids repeat or are missing, each row is a document of its own; a row without an id comes after all with one, so it
    stays only if no copy of it has an id. Empty texts are nobody's copies. An empty table stays empty.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null")
    if repeated.isEmpty():
        dropped = near_dedup.components(docs).where("not kept").select(F.col("doc_id").alias("dropped_id"))
        return docs.join(dropped, F.col("doc_id") == F.col("dropped_id"), "left_anti")
    # Numbers in the order of the ids; the position breaks ties, so that a hot id is spread over partitions.
    placed = docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("place"))
    order = [F.col("row.doc_id").asc_nulls_last(), F.col("place")]
    numbered = saved(placed.repartitionByRange(*order).sortWithinPartitions(*order).select("row", F.monotonically_increasing_id().alias("number")))
    dropped = near_dedup.components(numbered.select("number", "row.text"), id_col="number").where("not kept").select(F.col("doc_id").alias("dropped_number"))
    kept = numbered.join(dropped, F.col("number") == F.col("dropped_number"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; a null text stays null and an empty one empty."""
    masked = docs.withColumn("text", F.when(F.col("text").isNotNull(), secret_scan.redacted("text")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, a row per epoch that takes them. A document without words is in no mix; a null source is a source of
    its own; repeated rows share their copies evenly."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences: a row per piece. A null text is an empty one; long texts are cut."""
    return packing.packed(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("packing", pack)]

#: Token ids and packing are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_path(spark)}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage) -> DataFrame:
        name, function = stage
        function(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
