"""Gradient-boosted models for cancellation, revenue per night and upsell."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.operators.boosting import as_model, boosted
from harborline.operators.metrics import accuracy, auc_roc, mean_absolute_error, r_squared
from harborline.operators.split import stratified_split
from harborline.operators.trees import importances, read_trees, score_rows
from harborline.plans.features import FEATURES, revenue_per_night, with_upsell_label
from harborline.sources.durable import stored

LABEL_INPUTS = ["is_cancelled", "total_onboard_spend_usd", "total_guest_value_usd", "nights"]
SEED = 42
TEST_SHARE = 0.2
PART_ROWS = 5_000_000  # rows that a fit holds in one part, some 700 MB


@dataclass(frozen=True)
class ModelSpec:
    run: str
    classifier: bool
    trees: int
    depth: int
    rate: float
    subsample: float
    prepare: Callable[[DataFrame], DataFrame]  # frame -> rows with a label column


def _cancellation(frame: DataFrame) -> DataFrame:
    return frame.withColumn("label", F.col("is_cancelled").cast("int").cast("double"))


def _revenue(frame: DataFrame) -> DataFrame:
    return frame.where(~F.col("is_cancelled")).withColumn("label", revenue_per_night())


def _upsell(frame: DataFrame) -> DataFrame:
    return with_upsell_label(frame).withColumn("label", F.col("high_spender").cast("double"))


# Boosting settings of the three models.
SPECS = {
    "cancellation_risk": ModelSpec("cancellation_risk", True, 200, 4, 0.05, 0.8, _cancellation),
    "revenue_per_night": ModelSpec("revenue_per_night", False, 200, 5, 0.05, 0.8, _revenue),
    "upsell_propensity": ModelSpec("upsell_propensity", True, 150, 4, 0.08, 0.8, _upsell),
}


@dataclass
class TrainedModel:
    spec: ModelSpec
    model: PipelineModel
    scored: DataFrame  # test rows with prediction and, for classifiers, probability
    run_log: DataFrame  # (run, kind, key, value)
    importance: DataFrame  # (feature, importance), best first
    rows: DataFrame  # keys, inputs, label and is_test


def model_rows(frame: DataFrame, spec: ModelSpec, keys: list[str]) -> DataFrame:
    """Keys, the 18 inputs with NULL as 0, the label and ``is_test``."""
    rows = spec.prepare(frame).select(
        *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES], "label"
    )
    stratum = F.col("label").cast("int") if spec.classifier else None
    return stratified_split(rows, keys, stratum, TEST_SHARE, SEED)


def in_parts(rows: DataFrame, n: int) -> DataFrame:
    """``n`` rows for a fit, in as many parts of equal size as there are cores, or a multiple of that.

    Every level of every tree waits for the largest part and sends the counts of its nodes from
    each one, so the parts follow the cores, not the files: rows are dealt out one by one, once
    per fit, however unequal the files are. Parts are sorted, so that a fit draws the same rows
    again and a part lost on the way comes back in the order that its residuals are in.
    """
    cores = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(cores * max(1, -(-n // (cores * PART_ROWS))))
    return dealt.sortWithinPartitions(*rows.columns)


def positive_probability(name: str = "probability"):
    return vector_to_array(F.col(name))[1]


def score_metrics(scored: DataFrame, spec: ModelSpec) -> DataFrame:
    """``(key, value)`` metrics of scored test rows."""
    if spec.classifier:
        auc = auc_roc(scored, F.col("score"), F.col("label"))
        counted = scored.agg(accuracy(F.col("prediction"), F.col("label")).alias("accuracy"))
        counted = counted.withColumn("auc_roc", auc.scalar())
        names = ["accuracy", "auc_roc"]
    else:
        p, y = F.col("prediction"), F.col("label")
        counted = scored.agg(mean_absolute_error(p, y).alias("mae"), r_squared(p, y).alias("r2"))
        names = ["mae", "r2"]
    entries = [F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names]
    return counted.select(F.inline(F.array(*entries)))


def train(
    frame: DataFrame, spec: ModelSpec, keys: list[str], trees: int | None = None
) -> TrainedModel:
    """Fits one model; ``trees`` overrides the number of boosting rounds."""
    spark: SparkSession = frame.sparkSession
    rounds = spec.trees if trees is None else trees
    inputs = [*FEATURES, *[c for c in LABEL_INPUTS if c not in FEATURES]]
    rows = stored(model_rows(stored(frame.select(*keys, *inputs)), spec, keys))
    booster = GBTClassifier if spec.classifier else GBTRegressor
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        booster(
            featuresCol="features",
            labelCol="label",
            maxIter=rounds,
            maxDepth=spec.depth,
            stepSize=spec.rate,
            subsamplingRate=spec.subsample,
            seed=SEED,
        ),
    ]
    fitted = rows.where(~F.col("is_test")).select(*FEATURES, "label")
    n = fitted.count()
    found = boosted(
        in_parts(fitted, n), n, FEATURES, spec.classifier, rounds, spec.depth, spec.rate, spec.subsample, SEED
    )
    model = PipelineModel([stages[0], as_model(spark, stages[1], *found, spec.rate)])
    scored = model.transform(rows.where(F.col("is_test")))
    score = positive_probability() if spec.classifier else F.col("prediction")
    scored = stored(scored.select(*keys, "label", "prediction", score.alias("score")))
    weights = model.stages[-1].featureImportances.toArray()
    importance = spark.createDataFrame(
        [(n, float(w)) for n, w in zip(FEATURES, weights)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
    settings = {k: v for k, v in asdict(spec).items() if k in ("depth", "rate", "subsample")}
    params = spark.createDataFrame(
        [(k, float(v)) for k, v in {"trees": rounds, "seed": SEED, **settings}.items()],
        "key string, value double",
    ).withColumn("kind", F.lit("param"))
    sizes = rows.agg(
        F.count_if(~F.col("is_test")).cast("double").alias("train_rows"),
        F.count_if(F.col("is_test")).cast("double").alias("test_rows"),
    ).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("train_rows", "test_rows")]
            )
        )
    )
    metrics = score_metrics(scored, spec).unionByName(sizes).withColumn("kind", F.lit("metric"))
    run_log = params.unionByName(metrics).select(F.lit(spec.run).alias("run"), "kind", "key", "value")
    return TrainedModel(spec, model, scored, run_log, importance, rows)


def top_features(trained: TrainedModel, n: int = 5) -> DataFrame:
    return trained.importance.limit(n)


def save_model(trained: TrainedModel, path: str) -> None:
    trained.model.write().overwrite().save(path)


def score_saved(frame: DataFrame, path: str) -> DataFrame:
    """``frame`` with the prediction and score of the model saved at ``path``, walked as a table of
    nodes: rows are not moved."""
    return score_rows(frame, read_trees(frame.sparkSession, path), FEATURES)


def compare_with_nodes(trained: TrainedModel, keys: list[str], path: str) -> DataFrame:
    """One row: test rows, those that the saved nodes score as the model does, and the features
    whose importance follows from the nodes' gains."""
    save_model(trained, path)
    saved = read_trees(trained.rows.sparkSession, path)
    own = score_rows(trained.rows.where("is_test"), saved, FEATURES)
    walked = own.select(*keys, F.col("prediction").alias("p"), F.col("score").alias("s"))
    same = (F.abs(F.col("p") - F.col("prediction")) < 1e-9) & (F.abs(F.col("s") - F.col("score")) < 1e-9)
    scores = trained.scored.join(walked, keys, "left").agg(
        F.count("*").alias("test_rows"), F.count_if(same).alias("same_scores")
    )
    weights = importances(saved, FEATURES).withColumnRenamed("importance", "own")
    near = F.abs(F.col("own") - F.col("importance")) < 1e-9
    counted = trained.importance.join(weights, "feature").agg(F.count_if(near).alias("n"))
    return scores.select(
        F.lit(trained.spec.run).alias("run"), "test_rows", "same_scores", counted.scalar().alias("same_importances")
    )
