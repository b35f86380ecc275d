"""Revenue actions: proposals, decisions and the append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.functions.names import stamped_id
from harborline.plans.anomalies import first_anomalies

PENDING, APPROVED, REJECTED = "PENDING_APPROVAL", "APPROVED", "REJECTED"
ACT_ON = 2


_KEYS = ["brand", "itinerary_name", "region", "sail_year", "sail_quarter"]


def action_key(run_at: Column) -> Column:
    return stamped_id("ACT_", run_at, [F.col(k) for k in _KEYS])


def propose_actions(
    found: DataFrame,
    run_at: Column,
    recommendations: DataFrame | None = None,
    top: int | None = ACT_ON,
) -> DataFrame:
    """One pending action per anomaly; ``top=None`` proposes for all of them.

    ``recommendations(brand, itinerary_name, region, sail_year, sail_quarter,
    recommendation)`` holds texts made elsewhere; without it the column is NULL.
    """
    chosen = found if top is None else first_anomalies(found, top)
    if recommendations is None:
        chosen = chosen.withColumn("recommendation", F.lit(None).cast("string"))
    else:
        chosen = chosen.join(recommendations.select(*_KEYS, "recommendation"), _KEYS, "left")
    return chosen.select(
        F.date_format(run_at, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        "brand",
        F.col("itinerary_name").alias("itinerary"),
        "region",
        F.col("avg_occupancy").alias("current_occupancy"),
        F.col("avg_cancellation").alias("cancellation_rate"),
        "recommendation",
        F.lit(PENDING).alias("status"),
        action_key(run_at).alias("action_id"),
    )


def verdict(answer: Column) -> Column:
    """'yes' in any case approves, anything else rejects."""
    return F.when(F.lower(F.trim(answer)) == "yes", F.lit(APPROVED)).otherwise(F.lit(REJECTED))


def decide(
    actions: DataFrame, decisions: DataFrame | None = None, auto_approve: bool = False
) -> DataFrame:
    """Actions with their new status. ``decisions(action_id, answer)``; an action without a
    decision stays as it is."""
    if auto_approve or decisions is None:
        status = F.lit(APPROVED) if auto_approve else F.col("status")
        return actions.withColumn("status", status)
    answered = decisions.select("action_id", verdict(F.col("answer")).alias("_verdict"))
    return actions.join(answered, "action_id", "left").select(
        *[F.coalesce("_verdict", "status").alias(c) if c == "status" else F.col(c) for c in actions.columns]
    )


def log_events(actions: DataFrame, at: Column) -> DataFrame:
    """Rows for the append-only log."""
    return actions.select("action_id", "brand", "itinerary", "status", at.alias("at"))


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per action, folded from the log.

    Of events at one instant a decision comes after the proposal; two decisions are ordered
    by their status, so the result never depends on the order of rows.
    """
    decided = F.col("status") != PENDING
    latest = F.max(F.struct("at", decided.alias("decided"), "status", "brand", "itinerary")).alias("e")
    return events.groupBy("action_id").agg(latest).select(
        "action_id", "e.brand", "e.itinerary", "e.status", "e.at"
    )
