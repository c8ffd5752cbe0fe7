"""Materialised intermediates and the shared working folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local session without that setting gets a temporary one.

    A cluster without the setting is refused, since a folder of one machine is not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarterhour-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared(df: DataFrame) -> DataFrame:
    """Compute a frame once and store it in the shared folder, so several branches of a plan can read it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads, none if there is no such folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
