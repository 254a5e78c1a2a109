"""Factor handling (O-16, O-17): level codes the way R's ``as.numeric(factor)`` gives them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators.window import with_row_number


def as_factor(df: DataFrame, column: str, levels: list[str] | None = None) -> DataFrame:
    """A text column with its list of levels in the metadata (O-16): those found, or the given ones.

    Values outside the given levels become missing, as a factor has no other
    values. The list is as long as the factor, never as the data.
    """
    text = F.col(column).cast("string")
    if levels is None:
        levels = sorted(r[0] for r in df.select(text).distinct().collect() if r[0] is not None)
        value = text
    else:
        value = F.when(text.isin(*levels), text) if levels else F.lit(None).cast("string")
    return df.select(*[value.alias(c, metadata={**(df.schema[c].metadata or {}), "levels": list(levels)}) if c == column else F.col(c) for c in df.columns])


def level_codes(df: DataFrame, column: str, out: str = "level", levels: list | None = None) -> DataFrame:
    """1-based level code in sorted level order (O-17); null stays null.

    Not ``StringIndexer`` (0-based, frequency order). The distinct levels are
    numbered in one global order and joined back, whatever their number; the
    planner broadcasts them when they are small. A given level list becomes
    a literal map instead.
    """
    if levels is not None:
        if not levels:
            return df.withColumn(out, F.lit(None).cast("int"))
        mapping = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i + 1)) for i, v in enumerate(levels)))
        return df.withColumn(out, F.try_element_at(mapping, F.col(column)).cast("int"))
    known = df.select(F.col(column).alias("_level")).where(F.col("_level").isNotNull()).distinct()
    numbered = with_row_number(known, ["_level"], out="_code").select("_level", F.col("_code").cast("int").alias("_code"))
    joined = df.join(numbered, F.col(column) == F.col("_level"), "left")
    return joined.withColumn(out, F.col("_code")).drop("_level", "_code")


def level_labels(code_col: str, labels: list[str]) -> "F.Column":
    """Code -> label (``METRO`` "0"->1->Rural, "1"->2->Urban)."""
    mapping = F.create_map(*chain.from_iterable((F.lit(i + 1), F.lit(v)) for i, v in enumerate(labels)))
    return F.try_element_at(mapping, F.col(code_col))
