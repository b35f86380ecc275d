"""Tables kept as whole versions: readers see the old one until the new one is complete."""

from __future__ import annotations

from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

COMPLETE = "_complete"  # written after all files of a version; Spark's readers pass over it


class Version(NamedTuple):
    number: int
    batch: int | None
    folder: str


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _version(folder: str) -> Version:
    number, batch, _ = folder.rsplit("/", 1)[1].removeprefix("v").split("-")
    return Version(int(number), int(batch) if batch else None, folder)


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The complete versions under ``path``, oldest first."""
    marks = _files(spark, path).globStatus(_path(spark, f"{path}/v*/{COMPLETE}"))
    found = [_version(m.getPath().getParent().toString()) for m in marks or []]
    return sorted(found, key=lambda v: (v.number, v.folder))


def has_batch(spark: SparkSession, path: str, batch: int) -> bool:
    """Whether the newest version already holds this batch or a later one."""
    done = versions(spark, path)
    return bool(done) and done[-1].batch is not None and done[-1].batch >= batch


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version; ``None`` where there is none."""
    done = versions(spark, path)
    return spark.read.parquet(done[-1].folder) if done else None


def write_version(df: DataFrame, path: str, batch: int | None = None, keep: int = 2) -> bool:
    """Writes the rows as the next version and returns whether it did.

    A job that fails on the way leaves a folder without its mark, which no reader sees.
    With ``batch``, a number that grows from write to write, a repeated write of a batch
    does nothing. The last ``keep`` versions stay for readers that have begun; what is older
    goes. One table has one writer at a time. The rows may come from the version before.
    """
    spark = df.sparkSession
    done = versions(spark, path)
    if batch is not None and has_batch(spark, path, batch):
        return False
    if batch is None and done:
        batch = done[-1].batch
    number = done[-1].number + 1 if done else 0
    folder = f"{path}/v{number:010d}-{'' if batch is None else batch}-{uuid4().hex}"
    df.write.parquet(folder)
    files = _files(spark, path)
    files.create(_path(spark, f"{folder}/{COMPLETE}")).close()
    held = [v.number for v in done][1 - keep :] if keep > 1 else []
    oldest = min([*held, number])
    for found in files.globStatus(_path(spark, f"{path}/v*")):
        if _version(found.getPath().toString()).number < oldest:
            files.delete(found.getPath(), True)
    return True
