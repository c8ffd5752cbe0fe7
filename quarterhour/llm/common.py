"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Java and DuckDB pattern of a word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    A local session without the setting gets a folder of its own; a cluster without it is refused, since a folder of one
    machine would not be seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarterhour-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, so that a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_path(df.sparkSession))
    return df.checkpoint(eager=True)


def texts(column: pa.Array):
    """The strings of an Arrow column one at a time; a missing one is empty."""
    for x in column:
        yield x.as_py() or ""


def fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def records(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], names=list(columns))


def structs(columns: dict[str, tuple[list, pa.DataType]]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(values, kind) for values, kind in columns.values()], names=list(columns))
