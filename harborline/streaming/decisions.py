"""Approval decisions and bookings as streams: into the action log, into a mart's state."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harborline.plans import marts
from harborline.plans.actions import verdict
from harborline.plans.increments import add_state
from harborline.sources.sinks import append_log

DECISIONS = "action_id string, answer string, decided_at timestamp_ntz"


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(DECISIONS).json(folder)


def decided_events(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Log events of decisions on known actions."""
    known = actions.select("action_id", "brand", "itinerary")
    return decisions.join(known, "action_id").select(
        "action_id",
        "brand",
        "itinerary",
        verdict(F.col("answer")).alias("status"),
        F.col("decided_at").alias("at"),
    )


def log_decisions(
    decisions: DataFrame, actions: DataFrame, log: str, checkpoint: str
) -> StreamingQuery:
    """Appends all decisions available now; a restart continues from the checkpoint.

    A decision that is delivered again, the same answer at the same time, is logged once:
    the stream's state remembers what it has seen of every action, one small row per
    decision. A batch that is run again after a failure replaces its first try in the log;
    the stream's id keeps batches of different streams apart.
    """
    events = decided_events(decisions, actions).dropDuplicates(["action_id", "status", "at"])

    def append(rows: DataFrame, batch: int) -> None:
        append_log(rows, log, f"{_stream_id(rows.sparkSession, checkpoint)}-{batch}")

    return (
        events.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def log_deliveries(bookings: DataFrame, occupancy: str, checkpoint: str) -> StreamingQuery:
    """Folds bookings as they arrive into the occupancy state at ``occupancy``.

    A batch that is run again changes nothing. Batches are numbered by the checkpoint, so
    state and checkpoint belong together. ``marts.occupancy_of`` makes the mart of it.
    """

    def add(rows: DataFrame, batch: int) -> None:
        add_state(marts.occupancy_state(rows), occupancy, marts.OCCUPANCY_KEYS, batch)

    return (
        bookings.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]
