"""Table readers: CSV files, table maps, catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from harborline.schemas import RAW_TABLES, to_contract


def read_csv(
    spark: SparkSession, path: str, contract: T.StructType, multi_line: bool = True
) -> DataFrame:
    """CSV with a header, its columns found by name in any order and case, then cast.

    Only the header is read ahead. Quotes inside a cell are doubled, as in any standard CSV
    file, and a quoted cell may hold line breaks. An empty cell is NULL, the text ``None``
    stays text; a malformed cell, a short row and a long one are errors.

    With line breaks in cells a file cannot be split, so each file is one task; ``write_csv``
    bounds its files for that. ``multi_line=False`` splits large files whose cells have none.
    """
    reader = spark.read.options(
        header=True, quote='"', escape='"', mode="FAILFAST", multiLine=multi_line
    )
    names = reader.csv(path).columns
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # without pruning every row is parsed in full, so its length is checked
    return to_contract(reader.option("columnPruning", False).schema(texts).csv(path), contract)


def load_tables(
    spark: SparkSession, paths: dict[str, str], contracts: dict[str, T.StructType] | None = None
) -> dict[str, DataFrame]:
    """Reads every table of a name -> path map and registers it as a temporary view."""
    contracts = RAW_TABLES if contracts is None else contracts
    loaded = {}
    for name, path in paths.items():
        df = read_csv(spark, path, contracts[name.lower()])
        df.createOrReplaceTempView(name)
        loaded[name] = df
    return loaded


def source(spark: SparkSession, schema: str, table: str) -> DataFrame:
    return spark.table(f"{schema}.{table}")


def upper_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.upper() for c in df.columns])
