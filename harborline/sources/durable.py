"""Cutting lineage through the folder the cluster shares."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    active = spark.sparkContext.getCheckpointDir()
    if active:
        return active.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="harborline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, by: str | None = None, codec: str | None = None) -> DataFrame:
    """The same rows, written once as a parquet table in the shared folder.

    For relations with several readers: a lost executor costs no recomputation, readers
    still prune columns, and the planner knows the real size. ``by`` names a column with few
    values that gets a folder per value; a join on it reads only the folders it needs.
    ``codec`` names the files' compression where the session's is too weak.
    """
    path = f"{shared_folder(df.sparkSession)}/harborline-{uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
