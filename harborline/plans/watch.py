"""Revenue watch: detect, enrich, propose, decide - one job from mart to logged actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from harborline.config import CRUISE, DomainConfig
from harborline.operators.wordindex import WordIndex
from harborline.plans.actions import ACT_ON, action_key, decide, propose_actions
from harborline.plans.anomalies import anomalies, first_anomalies
from harborline.plans.enrichment import anomaly_key, anomaly_prompts
from harborline.sources.durable import stored


def revenue_watch(
    occupancy: DataFrame,
    documents: DataFrame,
    run_at: Column,
    config: DomainConfig = CRUISE,
    top: int = ACT_ON,
    index: WordIndex | None = None,
    decisions: DataFrame | None = None,
    auto_approve: bool = False,
    recommendations: DataFrame | None = None,
) -> DataFrame:
    """Actions on the most urgent anomalies, each with its prompt and current status.

    Recommendations are written elsewhere, from the prompts; a table of them, see
    ``propose_actions``, fills the column, which is NULL without one.
    """
    found = anomalies(occupancy, config.min_occupancy, config.max_cancellation, config.scan_limit)
    chosen = stored(first_anomalies(found, top))
    proposed = propose_actions(chosen, run_at, recommendations, top=None)
    decided = decide(proposed, decisions, auto_approve)
    prompts = (
        chosen.select(anomaly_key().alias("query_id"), action_key(run_at).alias("action_id"))
        .join(anomaly_prompts(chosen, documents, index=index), "query_id")
        .drop("query_id")
    )
    return decided.join(prompts, "action_id").select(*decided.columns, "prompt")
