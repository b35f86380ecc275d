"""Registered queries over the star-schema test tables, and their SQL counterparts."""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce, wraps
from uuid import uuid4

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.functions.numeric import decimals_to_double, row_total
from harborline.operators import cells, lookup, metrics, profile, quality, retrieval, split, wordindex
from harborline.plans import (
    actions,
    anomalies,
    enrichment,
    features,
    increments,
    marts,
    models,
    questions,
    staging,
    summaries,
    watch,
)
from harborline.plans.warehouse import Warehouse
from harborline.schemas import RAW_TABLES
from harborline.sources import sinks, tables
from harborline.sources.durable import shared_folder, stored
from harborline.sources.star import STAR_CONFIG, StarSource
from oracle_queries import ORACLE, QUESTIONS, RUN_AT

try:  # the training-data operators and their pipeline are an optional part
    import corpus_pipeline
    from harborline.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "harborline.llm"):
        raise
    corpus_pipeline = llm_queries = None

EMBEDDING_SIZE = 64

HERE = os.path.dirname(os.path.abspath(__file__))
Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _query(fn: Callable[[StarSource, Warehouse], DataFrame]) -> Callable:
    """Registers a query over one folder; decimals leave as doubles."""

    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        star = StarSource(spark, folder)
        return decimals_to_double(fn(star, _warehouse(star)))

    _REGISTRY[fn.__name__] = run
    return fn


def _warehouse(star: StarSource) -> Warehouse:
    return Warehouse(star, STAR_CONFIG, spend_is_unique=True)  # the source groups spend by booking


# --- staging -------------------------------------------------------------------------


@_query
def stg_bookings(star, wh):
    return staging.stage_bookings(star.as_text("bookings"))


@_query
def stg_guests(star, wh):
    return staging.stage_guests(star.as_text("guests"))


@_query
def stg_onboard_spend(star, wh):
    return staging.stage_onboard_spend(star.as_text("onboard_spend"))


@_query
def stg_pricing_log(star, wh):
    return staging.stage_pricing_log(star.as_text("pricing_log"))


# --- marts ---------------------------------------------------------------------------


@_query
def mart_revenue(star, wh):
    return wh.mart_revenue


@_query
def mart_occupancy(star, wh):
    return wh.mart_occupancy


@_query
def mart_guest_ltv(star, wh):
    return wh.mart_guest_ltv


@_query
def mart_revenue_by_line(star, wh):
    """Bookings with several spend rows: one result row per spend row."""
    return marts.mart_revenue(wh.stg_bookings, star.line_spend)


@_query
def mart_guest_ltv_by_line(star, wh):
    return marts.mart_guest_ltv(wh.stg_bookings, star.line_spend, wh.stg_guests, STAR_CONFIG)


@_query
def mart_pricing_summary(star, wh):
    return wh.staged("stg_bookings", "stg_pricing_log").mart_pricing_summary


# --- rollups and documents -----------------------------------------------------------


@_query
def occupancy_quarterly(star, wh):
    return summaries.occupancy_quarterly(wh.mart_occupancy)


@_query
def revenue_quarterly(star, wh):
    return summaries.revenue_quarterly(wh.mart_revenue)


@_query
def pricing_quarterly(star, wh):
    return summaries.pricing_quarterly(wh.mart_pricing_summary)


@_query
def region_brand_scorecard(star, wh):
    return summaries.region_brand_scorecard(wh.mart_occupancy)


@_query
def region_scorecard(star, wh):
    return summaries.region_scorecard(summaries.region_brand_scorecard(wh.mart_occupancy))


@_query
def docs_occupancy(star, wh):
    return summaries.docs_occupancy(summaries.occupancy_quarterly(wh.mart_occupancy))


@_query
def docs_revenue(star, wh):
    return summaries.docs_revenue(summaries.revenue_quarterly(wh.mart_revenue))


@_query
def docs_pricing(star, wh):
    return summaries.docs_pricing(summaries.pricing_quarterly(wh.mart_pricing_summary))


@_query
def docs_aggregate(star, wh):
    return summaries.docs_aggregate(summaries.region_brand_scorecard(wh.mart_occupancy))


@_query
def docs_all(star, wh):
    return wh.documents


# --- anomalies, actions, prompts -----------------------------------------------------


def _found(wh) -> DataFrame:
    return anomalies.anomalies(wh.mart_occupancy)


@_query
def anomaly_report(star, wh):
    return _found(wh)


@_query
def anomaly_report_unlimited(star, wh):
    return anomalies.anomalies(wh.mart_occupancy, scan_limit=None)


@_query
def anomaly_top3(star, wh):
    return anomalies.first_anomalies(_found(wh), 3)


def _run_at():
    return F.lit(RUN_AT).cast("timestamp_ntz")


@_query
def action_log(star, wh):
    return actions.propose_actions(_found(wh), _run_at())


@_query
def action_auto_approved(star, wh):
    return actions.decide(actions.propose_actions(_found(wh), _run_at()), auto_approve=True)


def _all_actions(wh) -> DataFrame:
    """The stored action table: one pending action per anomaly."""
    found = anomalies.anomalies(wh.mart_occupancy, scan_limit=None)
    return stored(actions.propose_actions(found, _run_at(), top=None))


def _decisions(proposed: DataFrame) -> DataFrame:
    """An answer for the actions of two brands; the rest stay pending."""
    return proposed.where(F.col("brand") != "Luxury").select(
        "action_id", F.when(F.col("brand") == "Mass", F.lit(" YES ")).otherwise(F.lit("no")).alias("answer")
    )


@_query
def action_decisions(star, wh):
    proposed = _all_actions(wh)
    return actions.decide(proposed, _decisions(proposed))


@_query
def action_status(star, wh):
    proposed = _all_actions(wh)
    decided = actions.decide(proposed, _decisions(proposed))
    later = _run_at() + F.expr("interval 1 hour")
    events = actions.log_events(proposed, _run_at()).unionByName(
        actions.log_events(decided.where(F.col("status") != actions.PENDING), later)
    )
    return actions.current_status(events)


@_query
def anomaly_context(star, wh):
    asked = stored(enrichment.anomaly_queries(_found(wh)))
    return enrichment.context_for(asked, wh.document_index)


@_query
def prompt_table(star, wh):
    found = _found(wh)
    return enrichment.anomaly_prompts(found, wh.document_index)


def _questions(star: StarSource) -> DataFrame:
    return star.spark.createDataFrame(QUESTIONS, "query_id string, text string")


@_query
def question_prompts(star, wh):
    return enrichment.question_prompts(_questions(star), wh.document_index)


@_query
def revenue_watch(star, wh):
    return watch.revenue_watch(
        wh.mart_occupancy, wh.document_index, _run_at(), STAR_CONFIG, auto_approve=True
    )


# --- questions -----------------------------------------------------------------------


@_query
def q_region_performance(star, wh):
    return questions.region_performance(wh.mart_revenue)


@_query
def q_region_cancellation(star, wh):
    return questions.region_cancellation(wh.mart_occupancy)


@_query
def q_brand_region(star, wh):
    return questions.brand_in_region(wh.mart_revenue, "Premium", "ASIA")


@_query
def q_suite_rpn(star, wh):
    return questions.cabin_revenue_per_night(wh.mart_revenue, "Luxury", "%M%")


@_query
def q_cabin_spend(star, wh):
    return questions.cabin_onboard_spend(wh.mart_revenue)


@_query
def q_tier_ltv(star, wh):
    return questions.tier_lifetime_value(wh.mart_guest_ltv)


@_query
def q_price_compare(star, wh):
    return questions.price_comparison(wh.mart_pricing_summary, "ASIA", ["Premium", "Mass"])


@_query
def q_window_trend(star, wh):
    return questions.booking_window_trend(wh.mart_occupancy, "EUROPE")


@_query
def q_overall(star, wh):
    return questions.overall_by_brand(wh.mart_revenue)


@_query
def q_problem_areas(star, wh):
    return questions.problem_areas(wh.mart_occupancy)


@_query
def q_free_sql(star, wh):
    return questions.run_sql(
        star.spark,
        """```sql
        SELECT o.brand, o.sail_year, SUM(o.confirmed_bookings) AS confirmed_bookings
        FROM mart_occupancy o GROUP BY o.brand, o.sail_year
        ```""",
        {"mart_occupancy": wh.mart_occupancy},
    )


@_query
def result_lines(star, wh):
    found = questions.region_performance(wh.mart_revenue)
    return questions.result_lines(found, [F.desc("total_revenue"), F.asc("region")])


@_query
def reply_parsing(star, wh):
    turns = star.table("conversations")
    verdict = F.when(F.col("turn") % 2 == 0, F.lit("Yes")).otherwise(F.lit("no"))
    reply = F.concat(
        F.lit("ANSWERABLE: "),
        verdict,
        F.lit("\nREASON: "),
        F.col("text"),
        F.when(F.col("role") == "system", F.lit("")).otherwise(F.concat(F.lit("\nSUGGESTION: "), "role")),
    )
    statement = F.concat(F.lit("```sql\n"), F.col("text"), F.lit("\n```"))
    replies = turns.select("conv_id", "turn", reply.alias("reply"), statement.alias("statement"))
    parsed = questions.parse_validation(questions.clean_statements(replies, "statement"), "reply")
    return parsed.drop("reply")


@_query
def chat_transcript(star, wh):
    turns = star.table("conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    replied = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    none = F.lit(None).cast("string")
    answers = asked.join(replied, ["conv_id", "turn"], "left").withColumns({"sql": none, "results": none})
    replies = asked.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit("assistant").alias("role"))
    others = turns.where(F.col("role") != "user").join(replies, ["conv_id", "turn", "role"], "left_anti")
    alone = others.select(
        "conv_id", "turn", "role", F.col("text").alias("content"), none.alias("sql"), none.alias("results")
    )
    return questions.transcript(answers, ["conv_id", "turn"]).unionByName(alone)


# --- quality -------------------------------------------------------------------------


@_query
def dq_unique(star, wh):
    return quality.duplicated_values(star.table("lineitem"), "l_orderkey")


@_query
def dq_not_null(star, wh):
    return quality.null_rows(wh.stg_bookings, "cancellation_reason").select("booking_id")


@_query
def dq_accepted(star, wh):
    return quality.unaccepted_values(wh.stg_bookings, "brand", ["Mass", "Premium"])


@_query
def dq_suite(star, wh):
    return wh.quality()


# --- reading and writing --------------------------------------------------------------


def _fresh_path(star: StarSource, name: str) -> str:
    return f"{shared_folder(star.spark)}/{name}-{uuid4().hex}"


@_query
def csv_round_trip(star, wh):
    """Guests written as CSV files and read back by a table map."""
    path = _fresh_path(star, "guests-csv")
    sinks.write_csv(wh.stg_guests, path)
    return tables.load_tables(star.spark, {"STG_GUESTS": path})["STG_GUESTS"]


@_query
def csv_documents(star, wh):
    """Documents, whose texts hold line breaks and quotes, written as CSV files and read back."""
    path = _fresh_path(star, "documents-csv")
    documents = star.table("documents")
    sinks.write_csv(documents, path)
    return tables.read_csv(star.spark, path, documents.schema)


@_query
def table_overwrite(star, wh):
    """Rows written when the rows of an existing table are replaced."""
    name = f"occupancy_{uuid4().hex}"
    table = sinks.save_table(wh.mart_occupancy.limit(0), name, "harborline_checks")
    rows = sinks.overwrite_table(wh.mart_occupancy, table)
    star.spark.sql(f"DROP TABLE {table}")
    return star.spark.range(1).select(F.lit(rows).cast("long").alias("rows_written"))


@_query
def saved_mart(star, wh):
    """A mart saved as a table of a schema and read by its source name."""
    name = f"occupancy_{uuid4().hex}"
    table = sinks.save_table(wh.mart_occupancy, name, " harborline_checks ")
    read = stored(tables.source(star.spark, "HARBORLINE_CHECKS", name))
    star.spark.sql(f"DROP TABLE {table}")
    return read


def _over_saved(star, wh, names: list[str], mart: str) -> DataFrame:
    """A mart over bucketed tables, which go when its rows are stored."""
    schema = f"HARBORLINE_{uuid4().hex}".upper()
    buckets = int(star.spark.conf.get("spark.sql.shuffle.partitions"))
    wh.saved(schema, buckets, names)
    rows = stored(getattr(wh.from_saved(star.spark, schema, names), mart))
    star.spark.sql(f"DROP SCHEMA `{schema}` CASCADE")
    return rows


@_query
def mart_revenue_saved(star, wh):
    """Bookings meet their spend in tables bucketed by booking."""
    return _over_saved(star, wh, ["stg_bookings", "stg_onboard_spend"], "mart_revenue")


@_query
def mart_guest_ltv_saved(star, wh):
    """Lifetime metrics meet their guests in tables bucketed by guest."""
    names = ["stg_bookings", "stg_onboard_spend", "stg_guests", "ltv_state"]
    return _over_saved(star, wh, names, "mart_guest_ltv")


def _delivered(star, wh) -> increments.MartStates:
    """All bookings in three deliveries by booking date, the second of them given twice."""
    kept = wh.staged("stg_bookings", "stg_onboard_spend")
    states = increments.MartStates(star.spark, _fresh_path(star, "states"), wh.config)
    year = F.coalesce(F.year("booking_date"), F.lit(0))
    parts = [year < 1994, (year >= 1994) & (year < 1996), year >= 1996]
    for batch in (0, 1, 1, 2):
        states.add(kept.stg_bookings.where(parts[batch]), kept.stg_onboard_spend, batch)
    return states


@_query
def mart_occupancy_delivered(star, wh):
    return _delivered(star, wh).occupancy()


@_query
def mart_guest_ltv_delivered(star, wh):
    return _delivered(star, wh).guest_ltv(wh.stg_guests)


@_query
def mart_pricing_delivered(star, wh):
    return _delivered(star, wh).pricing_summary(stored(wh.stg_pricing_log))


@_query
def index_update(star, wh):
    """Half of the documents as an index, then all as an update that is given twice."""
    path = _fresh_path(star, "index")
    documents = wh.document_index
    old = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).withColumn("text", F.lit("old"))
    gone = old.select(F.concat("doc_id", F.lit("_gone")).alias("doc_id"))
    sinks.write_index(old.unionByName(old.withColumn("doc_id", F.concat("doc_id", F.lit("_gone")))), path)
    for _ in range(2):
        sinks.update_index(documents, path, gone, batch=1)
    return sinks.read_index(star.spark, path).select("doc_id", "text", "type", "brand")


@_query
def index_round_trip(star, wh):
    """The document index with its metadata, written and read back."""
    path = _fresh_path(star, "index")
    sinks.write_index(wh.document_index, path)
    return sinks.read_index(star.spark, path).select("doc_id", "text", "type", "brand")


@_query
def run_log_round_trip(star, wh):
    """Events appended in two runs, the second done twice; the log gives the current status."""
    path = _fresh_path(star, "log")
    proposed = stored(_all_actions(wh))
    decided = actions.decide(proposed, _decisions(proposed))
    sinks.append_log(actions.log_events(proposed, _run_at()), path)
    later = _run_at() + F.expr("interval 1 hour")
    changed = actions.log_events(decided.where(F.col("status") != actions.PENDING), later)
    for _ in range(2):
        sinks.append_log(changed, path, "decisions")
    return actions.current_status(sinks.read_log(star.spark, path))


# --- small operators -----------------------------------------------------------------


@_query
def guest_profile(star, wh):
    return profile.guest_profile(wh.stg_bookings)


@_query
def seasonal_price(star, wh):
    return features.seasonal_price(wh.stg_bookings, STAR_CONFIG)


@_query
def price_calendar(star, wh):
    brands = F.array(*[F.lit(b) for b in STAR_CONFIG.brands])
    offers = (
        star.table("part")
        .select(F.col("p_type").alias("cabin_category"))
        .distinct()
        .select(F.explode(brands).alias("brand"), "cabin_category")
    )
    days = star.table("orders").agg(
        F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b")
    )
    return features.price_calendar(
        star.places, offers, days.select("a").scalar(), days.select("b").scalar(), STAR_CONFIG
    )


@_query
def horizontal_spend(star, wh):
    parts = STAR_CONFIG.spend_categories
    return wh.stg_onboard_spend.select(
        "booking_id", row_total([F.col(c) for c in parts]).alias("total_onboard_spend_usd")
    )


@_query
def cabin_codes(star, wh):
    return lookup.alphabetical_codes(wh.stg_bookings, "cabin_category")


@_query
def cancellation_rate(star, wh):
    return wh.stg_bookings.agg(
        F.count("*").alias("bookings"),
        F.avg(F.col("is_cancelled").cast("int")).alias("cancellation_rate"),
    )


# --- features, split, metrics, models ------------------------------------------------


@_query
def feature_frame(star, wh):
    wh = wh.staged("stg_bookings")
    return features.feature_frame(
        wh.mart_revenue, wh.mart_guest_ltv, STAR_CONFIG, bookings=wh.stg_bookings
    )


@_query
def feature_frame_fanout(star, wh):
    wh = wh.staged("stg_bookings")
    return features.feature_frame(
        wh.mart_revenue, wh.mart_guest_ltv, STAR_CONFIG, by_brand=False, bookings=wh.stg_bookings
    )


@_query
def stratified_split(star, wh):
    flagged = stored(wh.stg_bookings.select("booking_id", "is_cancelled"))
    return split.stratified_split(flagged, ["booking_id"], F.col("is_cancelled"))


@_query
def upsell_label(star, wh):
    spent = stored(wh.mart_revenue.select("booking_id", "is_cancelled", "total_onboard_spend_usd"))
    return features.with_upsell_label(spent).drop("is_cancelled")


@_query
def metric_auc(star, wh):
    score = F.col("booking_window_days") / F.lit(300.0)
    scored = wh.stg_bookings.select(
        score.alias("score"),
        F.col("is_cancelled").cast("int").alias("label"),
        (F.col("booking_window_days") > 140).cast("int").alias("prediction"),
    )
    measured = metrics.auc_roc(scored, F.col("score"), F.col("label"))
    return scored.agg(
        metrics.accuracy(F.col("prediction"), F.col("label")).alias("accuracy")
    ).select("accuracy", F.round(measured.scalar(), 9).alias("auc_roc"))


@_query
def metric_regression(star, wh):
    p, y = F.col("cabin_price_usd").cast("double") * 2.5, F.col("total_revenue_usd").cast("double")
    return wh.stg_bookings.agg(
        F.round(metrics.mean_absolute_error(p, y), 4).alias("mae"),
        F.round(metrics.r_squared(p, y), 6).alias("r2"),
    )


_FRAMES: dict[tuple[str, str], DataFrame] = {}
_TRAINED: dict[tuple[str, str, str], models.TrainedModel] = {}


def _model_frame(star: StarSource, wh: Warehouse) -> DataFrame:
    """The feature frame that all models are fitted on, stored once per session and folder."""
    key = (star.spark.sparkContext.applicationId, star.folder)
    if key not in _FRAMES:
        wh = wh.staged("stg_bookings")
        frame = features.feature_frame(
            wh.mart_revenue, wh.mart_guest_ltv, STAR_CONFIG, bookings=wh.stg_bookings
        )
        _FRAMES[key] = stored(frame)
    return _FRAMES[key]


def _train(name: str):
    """Each model is fitted once per session and folder, with all its rounds."""

    def run(star: StarSource, wh: Warehouse) -> models.TrainedModel:
        key = (star.spark.sparkContext.applicationId, star.folder, name)
        if key not in _TRAINED:
            _TRAINED[key] = models.train(_model_frame(star, wh), models.SPECS[name], ["booking_id"])
        return _TRAINED[key]

    return run


def _train_all(star: StarSource, wh: Warehouse) -> list[models.TrainedModel]:
    """All models, fitted side by side: a fit is many short jobs, between which cores would idle."""
    _model_frame(star, wh)
    with ThreadPoolExecutor(len(models.SPECS)) as pool:
        fit = inheritable_thread_target(star.spark)(lambda name: _train(name)(star, wh))
        return list(pool.map(fit, models.SPECS))


@_query
def gbt_cancellation(star, wh):
    return _train("cancellation_risk")(star, wh).run_log


@_query
def gbt_revenue(star, wh):
    return _train("revenue_per_night")(star, wh).run_log


@_query
def gbt_upsell(star, wh):
    return _train("upsell_propensity")(star, wh).run_log


@_query
def model_runs(star, wh):
    """What the three run logs say that does not depend on the fit, and a bound on each score."""
    logs = [trained.run_log for trained in _train_all(star, wh)]
    log = reduce(DataFrame.unionByName, logs)
    score = F.col("key").isin("auc_roc", "r2")
    bounded = F.when(score, (F.col("value") > 0.5).cast("double")).otherwise(F.col("value"))
    return log.where(score | F.col("key").isin("trees", "depth", "train_rows", "test_rows")).select(
        "run", "kind", "key", bounded.alias("value")
    )


@_query
def gbt_nodes(star, wh):
    """Each model saved, read back as a table of nodes and scored by it: rows and features that agree."""
    found = [
        models.compare_with_nodes(trained, ["booking_id"], _fresh_path(star, trained.spec.run))
        for trained in _train_all(star, wh)
    ]
    return reduce(DataFrame.unionByName, found)


@_query
def feature_importance(star, wh):
    return models.top_features(_train("revenue_per_night")(star, wh))


# --- retrieval -----------------------------------------------------------------------


def _vectors(star: StarSource) -> tuple[DataFrame, DataFrame]:
    """Mean vector of every label as queries, all vectors as the corpus."""
    stored = star.table("embeddings")
    mean = F.array(*[F.avg(F.get("embedding", F.lit(i))) for i in range(EMBEDDING_SIZE)])
    centroids = stored.groupBy(F.col("label").alias("query_id")).agg(mean.alias("embedding"))
    return centroids, stored.select(F.col("vec_id").alias("doc_id"), "embedding")


@_query
def cosine_topk(star, wh):
    centroids, corpus = _vectors(star)
    return retrieval.cosine_topk(centroids, corpus)


@_query
def lsh_topk(star, wh):
    centroids, corpus = _vectors(star)
    return retrieval.lsh_topk(centroids, corpus)


@_query
def lsh_quality(star, wh):
    """Share of the exact top-k that hashing finds, and of all pairs that it looks at."""
    centroids, corpus = _vectors(star)
    exact = retrieval.cosine_topk(centroids, corpus).select("query_id", "doc_id")
    index = retrieval.build_sign_index(corpus)
    found = stored(retrieval.lsh_candidates(centroids, index))
    hits = stored(exact).join(found, ["query_id", "doc_id"]).count()
    pairs = centroids.count() * corpus.count()
    return star.spark.range(1).select(
        F.lit(hits >= 0.9 * exact.count()).alias("recall_reached"),
        F.lit(found.count() <= 0.8 * pairs).alias("fewer_than_all_pairs"),
    )


def _every_fiftieth(star: StarSource) -> tuple[DataFrame, DataFrame]:
    """Vectors with an id divisible by 50 as queries, all vectors as the corpus."""
    corpus = _vectors(star)[1]
    return corpus.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), corpus


@_query
def ivf_topk(star, wh):
    return cells.ivf_topk(*_every_fiftieth(star))


@_query
def ivf_quality(star, wh):
    """Share of the exact top-k that the cells hold, and of all pairs whose codes are read."""
    asked, corpus = _every_fiftieth(star)
    index = cells.build_cell_index(corpus)
    exact = stored(retrieval.cosine_topk(asked, corpus).select("query_id", "doc_id"))
    hits = cells.search(asked, index).join(exact, ["query_id", "doc_id"]).count()
    share = cells.candidate_share(asked, index)
    return star.spark.range(1).select(
        F.lit(hits >= 0.9 * exact.count()).alias("recall_reached"), F.lit(share < 0.5).alias("below_half")
    )


@_query
def tfidf_topk(star, wh):
    index = wordindex.build_word_index(wh.document_index.select("doc_id", "text"))
    return wordindex.tfidf_topk(_questions(star), index)


@_query
def tfidf_documents(star, wh):
    index = wordindex.build_word_index(star.table("documents").select("doc_id", "text"))
    return wordindex.tfidf_topk(_questions(star), index)


# --- driver contract -----------------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Quarterly anomaly report of the smallest test set."""
    star = StarSource(spark, "/root/testdata/sf0.001")
    return decimals_to_double(anomalies.anomalies(_warehouse(star).mart_occupancy))


def _importable(query: Query) -> Query:
    """Python workers find the package also where the caller's folder is another one."""

    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if HERE not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, paths)])
        return query(spark, folder)

    return run


def queries() -> dict[str, Query]:
    found = dict(_REGISTRY)
    if llm_queries is not None:
        found |= {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}
    return {name: _importable(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    if llm_queries is None:
        return dict(ORACLE)
    piped = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**ORACLE, **llm_queries.ORACLE, **piped}
