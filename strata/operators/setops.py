"""Sort, top-k, set operations and cohorts (O-48 … O-52, O-60)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    """Descending sort with a limit (O-48, O-49): planned as TakeOrderedAndProject —
    each task keeps its own k best rows, the driver merges k x tasks rows."""
    return df.orderBy(*order_by).limit(k)


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``unique`` (O-52): partial de-duplication map-side, then one shuffle."""
    return (df.select(*columns) if columns else df).distinct()


def reorder_by_mean(df: DataFrame, category: str, value: str, out_mean: str = "mean_value") -> DataFrame:
    """Order categories by their mean (O-50): one row per category with its sort position.

    The mean is a partial/final hash aggregate; the position is a window over
    the aggregated result, whose size is the number of categories.
    """
    means = df.groupBy(category).agg(F.avg(value).alias(out_mean))
    w = Window.orderBy(F.col(out_mean).asc(), F.col(category).asc())
    return means.withColumn("position", F.row_number().over(w).cast("int"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """``rbind`` by name (O-51)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cohort_change(
    df: DataFrame,
    later: str,
    earlier: str,
    label: str,
    names: tuple[str, str, str, str] = ("Loss|Flag", "Gain|Flag", "Loss|NoFlag", "Gain|NoFlag"),
    legacy_labels: bool = False,
    out: str = "cohort",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Change cohorts (O-60, O-51, O-52, O-43): net = later - earlier, four labelled
    cohorts by sign of net x label, stacked and tallied. net = 0 or null is in no cohort.

    With ``keys``, rows that repeat an entity with the same values count once.

    The four filtered copies of the reference become one array of conditional
    labels per row (one scan, no union of four scans). ``legacy_labels=True``
    reproduces the reference filter of the no-flag loss cohort, which tests
    ``net > 0`` and therefore repeats the gain cohort.
    """
    if keys:
        df = distinct_rows(df, list(dict.fromkeys([*keys, later, earlier, label])))
    net = F.col(later) - F.col(earlier)
    flagged = F.col(label) == 1
    unflagged = F.col(label) == 0
    loss_no = (net > 0) if legacy_labels else (net < 0)
    tags = F.array(
        F.when((net < 0) & flagged, F.lit(names[0])),
        F.when((net > 0) & flagged, F.lit(names[1])),
        F.when(loss_no & unflagged, F.lit(names[2])),
        F.when((net > 0) & unflagged, F.lit(names[3])),
    )
    exploded = df.select(F.explode(F.filter(tags, lambda t: t.isNotNull())).alias(out))
    return exploded.groupBy(out).agg(F.count(F.lit(1)).alias("n"))
