"""Writers: CSV, views, tables, the document index, logs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from harborline.functions.names import schema_name
from harborline.sources.versions import has_batch, read_version, write_version

INDEX_METADATA = ["type", "brand", "region", "itinerary", "cabin", "position", "year", "quarter"]


def write_csv(df: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """CSV with a header; quotes inside a cell are doubled, line breaks and spaces are kept.

    A file holds at most ``rows_per_file`` rows, since one with line breaks inside cells is
    read by one task.
    """
    df.write.mode("overwrite").options(
        header=True,
        quote='"',
        escape='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        maxRecordsPerFile=rows_per_file,
    ).csv(path)


def _qualified(spark: SparkSession, table: str, schema: str | None, default: str) -> str:
    name = schema_name(schema, default)
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")
    return f"`{name}`.`{table}`"


def save_table(
    df: DataFrame,
    table: str,
    schema: str | None = None,
    default: str = "default",
    partition_by: list[str] | None = None,
    buckets: tuple[int, str] | None = None,
) -> str:
    """Overwrites a managed parquet table and returns its qualified name.

    ``buckets`` are a number and the column whose hash deals the rows into so many files.
    Joins and groupings on that column of tables with equal numbers need no shuffle. A
    column with hot values makes a large bucket, so it should be close to a key.
    """
    name = _qualified(df.sparkSession, table, schema, default)
    if buckets:
        df = df.repartition(*buckets)  # the same hash, so every bucket is one file
    writer = df.write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(*buckets)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return name


def overwrite_table(df: DataFrame, table: str) -> int:
    """Replaces the rows of a table that must already exist, and returns the rows written.

    Columns are matched by name; a missing or an extra column is an error. Rows are
    counted while they are written.
    """
    target = df.sparkSession.table(table)
    have, want = {c.lower() for c in df.columns}, [c.lower() for c in target.columns]
    if have != set(want):
        raise ValueError(f"{table}: columns differ: {sorted(have ^ set(want))}")
    rows = Observation()
    aligned = df.select(*[F.col(c) for c in want]).observe(rows, F.count(F.lit(1)).alias("rows"))
    aligned.write.insertInto(table, overwrite=True)
    return rows.get["rows"]


def _index_rows(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.struct(*INDEX_METADATA).alias("metadata"))


def write_index(documents: DataFrame, path: str) -> None:
    """Replaces the document index: id, text and typed metadata.

    Readers see the old index until the new one is complete.
    """
    write_version(_index_rows(documents), path)


def update_index(
    changed: DataFrame, path: str, removed: DataFrame | None = None, batch: int | None = None
) -> bool:
    """Puts changed documents in place of those with their ids, adds new ones, drops ``removed`` ids.

    An id that is both changed and removed goes. With ``batch``, a repeated update counts once.
    The index holds one document per group of bookings, so it is written anew as a whole.
    """
    spark = changed.sparkSession
    if batch is not None and has_batch(spark, path, batch):
        return False
    rows, old = _index_rows(changed), read_version(spark, path)
    if old is not None:
        rows = old.join(rows.select("doc_id"), "doc_id", "left_anti").unionByName(rows)
    if removed is not None:
        rows = rows.join(removed.select("doc_id"), "doc_id", "left_anti")
    return write_version(rows, path, batch)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    index = read_version(spark, path)
    if index is None:
        raise FileNotFoundError(f"no document index under {path}")
    return index.select("doc_id", "text", "metadata.*")


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append-only log: training runs, actions, decisions, chat turns.

    Every append is a folder of its own. With ``batch``, the name of one append among all
    of this log, an append that is done again takes the place of its first try, so a
    retried job logs its rows once.
    """
    folder = f"{path}/batch={uuid4().hex if batch is None else batch}"
    rows.write.mode("errorifexists" if batch is None else "overwrite").parquet(folder)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All appended rows, also those of files that lie in the log's folder itself."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)
