"""Registered queries: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import (
    binary,
    chat,
    filteraudit,
    fingerprints,
    hostrules,
    licenses,
    lm,
    mixing,
    neardup,
    packing,
    periodic,
    pii,
    sharding,
)
from harborline.llm.oracles import ORACLE
from harborline.llm.text import let, words

__all__ = ["ORACLE", "QUERIES"]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_documents(spark, folder))


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{folder}/conversations.parquet"))


def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return hostrules.judge(_documents(spark, folder))


def op4_masked_lm(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(_documents(spark, folder))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, folder))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal(_documents(spark, folder))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(_documents(spark, folder))


def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return binary.token_table(_documents(spark, folder))


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_documents(spark, folder))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filteraudit.audit(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_documents(spark, folder))


def looped(docs: DataFrame) -> DataFrame:
    """One text in ten, by the checksum of its id, repeats a stretch of words to its end."""
    check = F.crc32(F.col("doc_id").cast("string"))

    def repeat(x):
        ws, g, n = x["ws"], x["g"], F.size(x["ws"])
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = let(
            F.struct(ws.alias("ws"), a.alias("a"), p.alias("p")),
            lambda y: F.transform(
                F.slice(y["ws"], y["a"] + 1, F.size(y["ws"])),
                lambda w, i: F.get(y["ws"], y["a"] + i % y["p"]),
            ),
        )
        return F.array_join(F.concat(F.slice(ws, F.lit(1), a), tail), " ")

    parts = F.struct(words(F.col("text")).alias("ws"), F.floor(check / 10).alias("g"))
    again = let(parts, lambda x: F.when(F.size(x["ws"]) > 0, repeat(x)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(check % 10 == 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(looped(_documents(spark, folder)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = found.withColumn("best", periodic.most_repeated(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_chat_format,
        op3_host_rules,
        op4_masked_lm,
        op5_near_duplicates,
        op6_personal_data,
        op7_packing,
        op8_fingerprints,
        op9_token_files,
        op10_sharding,
        op11_filter_audit,
        op12_license_scan,
        op13_periodic_runs,
    )
}
