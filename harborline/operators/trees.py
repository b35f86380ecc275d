"""Fitted tree ensembles as tables of nodes: scoring and importances without the fitting library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SavedTrees:
    """A boosted ensemble read from the folder of a saved pipeline."""

    nodes: DataFrame  # (tree, node, feature, threshold, left, right, value, gain, weight, n_rows)
    classifier: bool
    depth: int


def read_trees(spark: SparkSession, path: str) -> SavedTrees:
    """The one boosted stage of a pipeline saved at ``path``.

    A node is a leaf where ``left`` is null. Rows with a feature up to the threshold go left.
    ``value`` is the node's prediction, ``weight`` its tree's share in the sum, ``n_rows`` the
    training rows it saw, ``gain`` what its split won by row.
    """
    stage = f"{path}/stages/*_GBT*"
    about = spark.read.text(f"{stage}/metadata").select(
        F.get_json_object("value", "$.class").alias("kind"),
        F.coalesce(
            F.get_json_object("value", "$.paramMap.maxDepth"), F.get_json_object("value", "$.defaultParamMap.maxDepth")
        )
        .cast("int")
        .alias("depth"),
    ).first()
    weights = spark.read.parquet(f"{stage}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n = F.col("nodeData")
    inner = n["leftChild"] >= 0
    nodes = spark.read.parquet(f"{stage}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, n["leftChild"]).alias("left"),
        F.when(inner, n["rightChild"]).alias("right"),
        n["prediction"].alias("value"),
        F.when(inner, n["gain"]).alias("gain"),
        F.get(n["impurityStats"], F.lit(0)).alias("n_rows"),
    )
    return SavedTrees(nodes.join(weights, "tree"), about["kind"].endswith("GBTClassificationModel"), about["depth"])


def _packed(nodes: DataFrame) -> DataFrame:
    """One row: the nodes of all trees as arrays, children and roots by their places there.

    A model has a bounded number of nodes, its rounds times 2 to the power of its depth.
    """
    before = Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)  # one row per tree
    trees = nodes.groupBy("tree").agg(F.count("*").alias("n"))
    firsts = trees.select("tree", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("root"))
    placed = nodes.join(firsts, "tree").select(
        (F.col("root") + F.col("node")).alias("at"),
        "feature",
        "threshold",
        (F.col("root") + F.col("left")).alias("left"),
        (F.col("root") + F.col("right")).alias("right"),
        (F.col("value") * F.col("weight")).alias("value"),
        F.when(F.col("node") == 0, F.col("root")).alias("root"),
    )
    listed = F.sort_array(F.collect_list(F.struct("at", "feature", "threshold", "left", "right", "value", "root")))
    row = placed.agg(listed.alias("n"))
    fields = ["feature", "threshold", "left", "right", "value"]
    roots = F.filter("n.root", lambda r: r.isNotNull())
    return row.select(F.struct(*[F.col(f"n.{c}").alias(c) for c in fields], roots.alias("roots")).alias("model"))


def _walker(nodes: DataFrame, depth: int) -> Callable[[np.ndarray], np.ndarray]:
    """The weighted sum of the leaves that every row of a matrix reaches, tree by tree."""
    model = _packed(nodes).first()["model"]
    size = len(model["value"])
    leaf = np.array([n is None for n in model["left"]], dtype=bool)
    here = np.arange(size)  # a leaf leads to itself

    def filled(field: str, other, kind: str) -> np.ndarray:
        return np.where(leaf, other, np.array([0 if v is None else v for v in model[field]])).astype(kind)

    feature, threshold = filled("feature", 0, "int64"), filled("threshold", 0.0, "float64")
    left, right = filled("left", here, "int64"), filled("right", here, "int64")
    value, roots = np.array(model["value"], dtype="float64"), model["roots"]

    def walk(inputs: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(inputs)), np.arange(len(inputs))
        for root in roots:
            at = np.full(len(inputs), root)
            for _ in range(depth):
                at = np.where(inputs[row, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return total

    return walk


def score_rows(rows: DataFrame, trees: SavedTrees, features: list[str]) -> DataFrame:
    """``rows`` with ``prediction`` and ``score``: for classifiers the probability of class 1, else
    the prediction itself. A null feature counts as 0, as in the training rows.

    The nodes, bounded by the rounds and the depth, travel to every task; rows stay where they
    are, and a batch of them walks down all trees one step at a time.
    """
    walk = _walker(trees.nodes, trees.depth)

    @F.pandas_udf("double")
    def summed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(walk(np.column_stack(batch)), dtype="float64")

    inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    score = 1 / (1 + F.exp(-2 * F.col("_sum"))) if trees.classifier else F.col("_sum")
    prediction = (F.col("score") > 0.5).cast("double") if trees.classifier else F.col("score")
    met = rows.withColumn("_sum", summed(*inputs))
    return met.withColumn("score", score).withColumn("prediction", prediction).drop("_sum")


def importances(trees: SavedTrees, features: list[str]) -> DataFrame:
    """``(feature, importance)`` of every feature: its share of what all splits won, each weighed
    by the training rows it saw."""
    won = trees.nodes.where("feature IS NOT NULL").groupBy("feature").agg(
        F.sum(F.col("gain") * F.col("n_rows")).alias("won")
    )
    named = F.array(*[F.lit(f) for f in features])
    listed = trees.nodes.sparkSession.range(1).select(F.posexplode(named).alias("number", "name"))
    joined = listed.join(won, listed["number"] == won["feature"], "left").select(
        F.col("name").alias("feature"), F.coalesce("won", F.lit(0.0)).alias("won")
    )
    whole = Window.partitionBy()  # one row per feature
    return joined.select("feature", (F.col("won") / F.sum("won").over(whole)).alias("importance"))
