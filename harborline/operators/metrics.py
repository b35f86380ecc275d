"""Model quality as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.operators.ranking import in_ranges, running_total


def auc_roc(scored: DataFrame, score: Column, label: Column) -> DataFrame:
    """One row ``(auc_roc)``: chance that a positive outranks a negative, ties half.

    Rows are folded by score. Negatives are then accumulated over ranges of scores that hold
    about as many scores each, and over scores inside those, so no window spans all scores
    wherever they lie or crowd.
    """
    by_score = (
        scored.select(score.cast("double").alias("s"), label.cast("int").alias("y"))
        .groupBy("s")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    )
    ranked = running_total(in_ranges(by_score, "s"), F.col("neg"), [["_range"], ["s"]], "below")
    wide = "decimal(19,0)"
    twice_wins = F.col("pos").cast(wide) * (2 * F.col("below") + F.col("neg")).cast(wide)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(
        (F.sum(twice_wins).cast("double") / F.nullif(2 * pairs, F.lit(0.0))).alias("auc_roc")
    )


def accuracy(prediction: Column, label: Column) -> Column:
    """Aggregate share of rows whose prediction equals the label."""
    return F.count_if(prediction.cast("int") == label.cast("int")).cast("double") / F.nullif(
        F.count("*"), F.lit(0)
    )


def mean_absolute_error(prediction: Column, label: Column) -> Column:
    """Mean of the errors; rows without a prediction or label do not count."""
    return F.avg(F.abs(prediction - label).cast("double"))


def r_squared(prediction: Column, label: Column) -> Column:
    """1 - residual / total sum of squares, in one pass, over rows that have both values.

    Sums of doubles depend on their order in the last digits; round what is reported.
    """
    known = F.when(prediction.isNotNull(), label)
    residual = F.sum(F.pow(label - prediction, F.lit(2.0)))
    total = F.var_pop(known) * F.count(known)
    return 1 - residual / F.nullif(total, F.lit(0.0))
