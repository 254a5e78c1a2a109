"""Model evaluation as DataFrame aggregates (O-73 … O-76, O-45 … O-47, O-56).

All metrics for all models come out of one grouped job over a long table
``(model, key…, label, score)``, instead of one evaluator job per model and
metric. Spark's ``BinaryClassificationEvaluator`` bins the ROC curve
(``numBins=1000``) on large inputs; the ranked AUC here is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.scalar import binarise
from strata.operators.window import ntile_by, running_sum, share_of_total, with_row_number


def auc_hard(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ("model",), scale: float = 100.0) -> DataFrame:
    """AUC of hard 0/1 predictions = (TPR + TNR) / 2 (O-73), x ``scale``.

    Null when a group has only one class (the curve is undefined).
    """
    y = F.col(label).cast("double")
    p = (F.col(prediction).cast("double") > 0.5).cast("double")
    pos, neg = F.sum(y), F.sum(1 - y)
    tpr = F.try_divide(F.sum(y * p), pos)
    tnr = F.try_divide(F.sum((1 - y) * (1 - p)), neg)
    return df.groupBy(*by).agg(((tpr + tnr) / 2 * F.lit(scale)).alias("auc"))


def auc_ranked(
    df: DataFrame, label: str, score: str, by: Sequence[str] = ("model",), scale: float = 100.0
) -> DataFrame:
    """Exact AUC with tie-averaged ranks (Mann-Whitney U), x ``scale``.

    Rows are ranked per group by score with the range-partitioned helper;
    tied scores get the mean of their first and last rank; then
    AUC = (R_pos - n_pos (n_pos + 1) / 2) / (n_pos n_neg). Only hash
    aggregates after the ranking, no single-partition window.
    """
    parts = list(by)
    ranked = with_row_number(df.select(*parts, label, score), [score], parts, out="_rn", split_ties=True)
    ties = ranked.groupBy(*parts, score).agg(
        ((F.min("_rn") + F.max("_rn")) / 2.0).alias("_avg_rank"),
        F.sum(F.col(label).cast("long")).alias("_pos"),
        F.count(F.lit(1)).alias("_cnt"),
    )
    sums = ties.groupBy(*parts).agg(
        F.sum(F.col("_avg_rank") * F.col("_pos")).alias("_r1"),
        F.sum("_pos").cast("double").alias("_n1"),
        (F.sum("_cnt") - F.sum("_pos")).cast("double").alias("_n0"),
    )
    u = F.col("_r1") - F.col("_n1") * (F.col("_n1") + 1) / 2.0
    return sums.select(*parts, (F.try_divide(u, F.col("_n1") * F.col("_n0")) * F.lit(scale)).alias("auc"))


def accuracy(
    df: DataFrame,
    label: str,
    prediction: str,
    cutpoint: float = 0.5,
    by: Sequence[str] = ("model",),
    scale: float = 100.0,
) -> DataFrame:
    """Accuracy after a strict ``> cutpoint`` binarisation (O-74, O-14), x ``scale``."""
    hit = (binarise(prediction, cutpoint) == F.col(label).cast("double")).cast("double")
    return df.groupBy(*by).agg((F.avg(hit) * F.lit(scale)).alias("accuracy"))


def metrics_long(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ("model",), cutpoint: float = 0.5
) -> DataFrame:
    """Model x (AUC, Accuracy) in long form (O-76), from one grouped aggregate."""
    y = F.col(label).cast("double")
    p = (F.col(prediction).cast("double") > 0.5).cast("double")
    hit = (binarise(prediction, cutpoint) == y).cast("double")
    tpr = F.try_divide(F.sum(y * p), F.sum(y))
    tnr = F.try_divide(F.sum((1 - y) * (1 - p)), F.sum(1 - y))
    wide = df.groupBy(*by).agg(
        ((tpr + tnr) / 2 * 100.0).alias("AUC"),
        (F.avg(hit) * 100.0).alias("Accuracy"),
    )
    return wide.unpivot(list(by), ["AUC", "Accuracy"], "metric", "value")


def decile_assign(
    df: DataFrame, score: str, tie_key: Sequence[str], by: Sequence[str] = ("model",), buckets: int = 10, out: str = "bin"
) -> DataFrame:
    """``ntile(desc(score), 10)`` per model (O-45) with a unique tie key, so the
    result does not depend on partitioning."""
    order: list[Column] = [F.col(score).desc(), *[F.col(k).asc() for k in tie_key]]
    return ntile_by(df, order, buckets, list(by), out)


def lift_table(
    df: DataFrame,
    label: str,
    score: str,
    tie_key: Sequence[str],
    by: str = "model",
    buckets: int = 10,
    base_name: str | None = "Base",
) -> DataFrame:
    """Cumulative gain per model (O-75): deciles -> positives per decile ->
    share of all positives -> running share; plus the base line (O-56).

    Everything after the decile assignment works on ``models x buckets`` rows.
    The base line is ``prop = (bin - 1) / (buckets - 1)`` — the reference's
    ``seq(0, 1, len = 10)`` — not ``bin / buckets``.
    """
    # The helper checkpoints what it is given; prune first (no pruning through a checkpoint).
    needed = list(dict.fromkeys([by, score, label, *tie_key]))
    bins = decile_assign(df.select(*needed), score, tie_key, [by], buckets)
    per_bin = bins.groupBy(by, "bin").agg(F.sum(F.col(label).cast("long")).alias("count"))
    shared = share_of_total(per_bin, "count", "share", [by])
    gains = running_sum(shared, "share", "bin", "prop", [by]).select(by, "bin", "prop")
    if base_name is None:
        return gains
    spark = df.sparkSession
    base = spark.range(1, buckets + 1).select(
        F.lit(base_name).alias(by),
        F.col("id").cast("int").alias("bin"),
        ((F.col("id") - 1) / F.lit(float(buckets - 1))).alias("prop"),
    )
    return gains.unionByName(base)
