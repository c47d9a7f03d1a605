"""Metrics of classifiers and regressors, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.relational import running_sums


def confusion(df: DataFrame, truth: str, score: str, threshold: float = 0.5, *by: str) -> DataFrame:
    """Counts of the four outcomes, with precision, recall, accuracy and F1 (null where they are 0 / 0)."""
    yes, said = F.col(truth) == 1, F.col(score) >= threshold
    counts = df.groupBy(*by).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0)
    return counts.withColumns({"precision": tp / F.nullif(tp + fp, zero), "recall": tp / F.nullif(tp + fn, zero), "accuracy": (tp + tn) / F.nullif(tp + fp + fn + tn, zero), "f1": 2 * tp / F.nullif(2 * tp + fp + fn, zero)})


def _pr_points(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Cases by distinct score, with the sums down to it."""
    points = df.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count("*").alias("n"))
    return running_sums(points, "score", ["pos", "n"], descending=True)


def pr_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, recall, precision): one point for each distinct score, from the highest down.

    Cases are counted by score first; the counts run in buckets of scores.
    """
    return _pr_points(df, truth, score).select("score", (F.col("pos_upto") / F.nullif(F.col("pos_all"), F.lit(0))).alias("recall"), (F.col("pos_upto") / F.col("n_upto")).alias("precision"))


def pr_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the precision-recall points by trapezoids; null for fewer than two points.

    The point before a score is its sums without its own cases: nothing is put in order again.
    """
    tp, said, before = F.col("pos_upto"), F.col("n_upto"), F.col("pos_upto") - F.col("pos")
    width = F.col("pos") / F.nullif(F.col("pos_all"), F.lit(0))
    height = (tp / said + before / F.nullif(said - F.col("n"), F.lit(0))) / 2
    return _pr_points(df, truth, score).agg(F.sum(width * height).alias("area"))
