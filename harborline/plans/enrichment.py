"""Retrieved context and prompt texts for anomalies and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.functions.text import render, thousands, two_decimals
from harborline.operators.wordindex import DEFAULT_K, WordIndex, build_word_index, tfidf_topk
from harborline.sources.durable import stored

# Formats of the retrieval query and of the prompts.
ANOMALY_QUERY = "{brand} {region} {itinerary} pricing occupancy"
ADVICE_PROMPT = """You are a cruise revenue pricing advisor.

A revenue anomaly has been detected:
- Brand: {brand}
- Itinerary: {itinerary}
- Region: {region}
- Current occupancy: {occupancy}%
- Cancellation rate: {cancellation}%
- Total revenue: ${revenue}

Relevant market context:
{context}

Provide a specific pricing recommendation to improve occupancy.
Include: recommended price adjustment (%), rationale, expected impact.
Keep response under 150 words."""

ANSWER_PROMPT = """Below are summaries drawn from the booking marts.

{context}

Reply to the question in a few sentences. Quote the figures you rely on, and name what the
summaries leave open.

Question: {question}

Reply:"""


def anomaly_key():
    keys = ["brand", "region", "itinerary_name", "sail_year", "sail_quarter"]
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def anomaly_queries(found: DataFrame) -> DataFrame:
    text = render(
        ANOMALY_QUERY,
        brand=F.col("brand"),
        region=F.col("region"),
        itinerary=F.col("itinerary_name"),
    )
    return found.select(anomaly_key().alias("query_id"), text.alias("text"))


def context_for(
    queries: DataFrame,
    documents: DataFrame,
    k: int = DEFAULT_K,
    index: WordIndex | None = None,
) -> DataFrame:
    """``(query_id, context)``: the k best documents as a bulleted list, best first."""
    # stored, so that the planner broadcasts the k rows per query by their real size
    best = stored(tfidf_topk(queries, index or build_word_index(documents), k))
    entry = F.struct("rank", F.concat(F.lit("- "), F.col("text")).alias("line"))
    return (
        documents.select("doc_id", "text")
        .join(best, "doc_id")
        .groupBy("query_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["line"]), "\n"
            ).alias("context")
        )
    )


def anomaly_prompts(
    found: DataFrame,
    documents: DataFrame,
    k: int = DEFAULT_K,
    index: WordIndex | None = None,
) -> DataFrame:
    """One prompt per anomaly, ready for any later consumer."""
    found = stored(found)  # read for the queries and again for the prompts
    context = context_for(anomaly_queries(found), documents, k, index)
    prompt = render(
        ADVICE_PROMPT,
        brand=F.col("brand"),
        itinerary=F.col("itinerary_name"),
        region=F.col("region"),
        occupancy=two_decimals(F.col("avg_occupancy")),
        cancellation=two_decimals(F.col("avg_cancellation")),
        revenue=thousands(F.col("total_revenue")),
        context=F.coalesce("context", F.lit("")),
    )
    return (
        found.withColumn("query_id", anomaly_key())
        .join(context, "query_id", "left")
        .select("query_id", prompt.alias("prompt"))
    )


def question_prompts(
    questions: DataFrame,
    documents: DataFrame,
    k: int = DEFAULT_K,
    index: WordIndex | None = None,
) -> DataFrame:
    """One answer prompt per ``questions(query_id, text)`` row."""
    context = context_for(questions, documents, k, index)
    prompt = render(ANSWER_PROMPT, context=F.coalesce("context", F.lit("")), question=F.col("text"))
    return questions.join(context, "query_id", "left").select("query_id", prompt.alias("prompt"))
