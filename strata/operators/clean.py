"""Missing data and key hygiene (O-25, O-29 … O-34).

R does not distinguish NaN from NA; Spark aggregates skip null but not NaN,
so every operator here treats both as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from strata.session import checkpoint_dir
from strata.operators.window import bounded_broadcast, with_row_number


def _is_missing(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (DoubleType, FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def key_length_filter(df: DataFrame, key: str, max_len: int = 2) -> DataFrame:
    """Keep rows whose text key has at most ``max_len`` characters (O-25).

    Drops total/summary rows with long keys; a null key is dropped too.
    Pushed to the scan as a data filter, pruning happens before any shuffle.
    """
    return df.filter(F.char_length(F.col(key)) <= max_len)


def fill_missing(
    df: DataFrame, number: float = 0, text: str | None = "0", keep_null: Sequence[str] = ()
) -> DataFrame:
    """Fill every missing value (O-29): numerics (null and NaN) with ``number``,
    text with ``text``. Columns in ``keep_null`` stay null, and so do factors
    (``categorical.as_factor``) that have no level ``text``: a later omission of
    incomplete rows drops their rows."""
    levels = {f.name: f.metadata["levels"] for f in df.schema.fields if "levels" in (f.metadata or {})}
    keep = {*keep_null, *(c for c, known in levels.items() if text not in known)}
    num_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keep]
    txt_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in keep]
    out = df.fillna(number, subset=num_cols) if num_cols else df
    if text is not None and txt_cols:
        out = out.fillna(text, subset=txt_cols)
    return out


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """``na.omit`` (O-30): drop a row if any (selected) column is null or NaN."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None, overall: str = "(all)") -> DataFrame:
    """Share of missing values per column plus the overall share (O-34), in one pass."""
    cols = list(columns) if columns else df.columns
    aggs = [F.avg(_is_missing(df, c).cast("double")).alias(c) for c in cols]
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    wide = df.agg(*aggs)
    total = sum((F.col(c) for c in cols), F.lit(0.0)) / F.lit(float(len(cols)))
    wide = wide.withColumn(overall, total).drop("_rows")
    return wide.unpivot([], [*cols, overall], "variable", "missing_share")


def null_policy_sum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums under both NA policies (O-32): ``sum_skip`` (na.rm=TRUE) and
    ``sum_propagate`` (NA if any input is NA), one aggregate pass, long form."""
    aggs = []
    for c in columns:
        v = F.when(~_is_missing(df, c), F.col(c))
        aggs.append(F.sum(v).cast("double").alias(f"s__{c}"))
        aggs.append(F.when(F.count(v) == F.count(F.lit(1)), F.sum(v)).cast("double").alias(f"p__{c}"))
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("variable"), F.col(f"s__{c}").alias("sum_skip"), F.col(f"p__{c}").alias("sum_propagate"))
        for c in columns
    ]
    return wide.select(F.inline(F.array(*rows)))


@dataclass
class RoughFix:
    """Fitted ``na.roughfix`` (O-33): medians of numerics, modes of categoricals."""

    fill: dict

    def transform(self, df: DataFrame) -> DataFrame:
        cols = []
        for f in df.schema.fields:
            if f.name in self.fill and self.fill[f.name] is not None:
                filled = F.when(~_is_missing(df, f.name), F.col(f.name)).otherwise(F.lit(self.fill[f.name]))
                cols.append(filled.cast(f.dataType).alias(f.name))
            else:
                cols.append(F.col(f.name))
        return df.select(*cols)


def _long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns])
        )
    ).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _middle(ranked: DataFrame, rank_col: str, offset: Column | None = None) -> DataFrame:
    """Mean of the values at ranks floor((n+1)/2) and ceil((n+1)/2)."""
    r = F.col(rank_col) + (offset if offset is not None else F.lit(0))
    k1, k2 = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    return ranked.filter((r == k1) | (r == k2)).groupBy("variable").agg(F.avg("value").alias("median"))


def exact_medians(
    df: DataFrame, columns: Sequence[str], accuracy: int = 10_000, force_full: bool = False
) -> DataFrame:
    """Exact median per column (R ``median``: mean of the two middle values), distributed.

    Exact selection without sorting whole columns:

    1. one aggregate per column gives its count and, from the
       ``percentile_approx`` sketch (rank error at most n / ``accuracy``), a
       value band [lo, hi] around the middle ranks;
    2. one aggregate counts the values below and inside the band;
    3. only values inside the band (about 4 n / ``accuracy`` per column) are
       ranked, with the range-partitioned row-number helper (ties split
       across partitions, so a hot value does not pile into one task).

    If the count check shows a band misses the middle ranks, that column falls
    back to ranking all its values, so the answer is always exact
    (``force_full`` takes that path for every column).
    """
    long = _long_values(df, columns)
    eps = 2.0 / accuracy
    sketch = long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", [max(0.0, 0.5 - eps), min(1.0, 0.5 + eps)], accuracy).alias("band"),
    )
    # One row per column: measured, then broadcast.
    bands = bounded_broadcast(sketch.select("variable", "n", F.col("band")[0].alias("lo"), F.col("band")[1].alias("hi")))
    tagged = long.join(bands, "variable")
    in_band = F.col("value").between(F.col("lo"), F.col("hi"))
    checks = tagged.groupBy("variable", "n").agg(
        F.sum((F.col("value") < F.col("lo")).cast("long")).alias("below"),
        F.sum(in_band.cast("long")).alias("inside"),
    )
    ok, fallback = [], []
    for row in checks.collect():  # one row per column
        k1, k2 = (row["n"] + 1) // 2, (row["n"] + 2) // 2
        holds = row["below"] < k1 and row["below"] + row["inside"] >= k2
        (ok if holds and not force_full else fallback).append(row["variable"])
    parts = []
    if ok:
        band_rows = tagged.filter(F.col("variable").isin(ok) & in_band).select("variable", "value", "n")
        ranked = with_row_number(band_rows, ["value"], ["variable"], out="rn", split_ties=True)
        below = checks.filter(F.col("variable").isin(ok)).select("variable", "below")
        ranked = ranked.join(F.broadcast(below), "variable")  # one row per column
        parts.append(_middle(ranked, "rn", F.col("below")))
    if fallback or not ok:  # nothing but missing values: an empty result of the same columns
        rows = long.filter(F.col("variable").isin(fallback))
        ranked = with_row_number(rows, ["value"], ["variable"], out="rn", split_ties=True, size_col="n")
        parts.append(_middle(ranked, "rn"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column; ties go to the smallest value.

    Three hash aggregates (count per value, best count per column, smallest
    value at the best count): partial aggregation everywhere, no group is
    collected into one task.
    """
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns]))
    ).filter(F.col("value").isNotNull())
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("variable").agg(F.max("cnt").alias("best"))
    return (
        counts.join(F.broadcast(best), "variable")  # one row per column
        .filter(F.col("cnt") == F.col("best"))
        .groupBy("variable")
        .agg(F.min("value").alias("mode"))
    )


def fit_roughfix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> RoughFix:
    """Fit the imputer: one small job for medians, one for modes; the fitted
    values (one per column) come back to the driver, like any Spark ML model."""
    fill: dict = {c: None for c in [*numeric, *categorical]}
    # The fit runs a few jobs over the same input: a reliable checkpoint serves
    # them all and survives a lost executor.
    checkpoint_dir(df.sparkSession)
    fixed = df.select(*numeric, *categorical).checkpoint(eager=True)
    if numeric:
        for row in exact_medians(fixed, numeric).collect():
            fill[row["variable"]] = row["median"]
    if categorical:
        for row in modes(fixed, categorical).collect():
            fill[row["variable"]] = row["mode"]
    return RoughFix(fill)


def roughfix_impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    return fit_roughfix(df, numeric, categorical).transform(df)
