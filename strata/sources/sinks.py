"""Sinks: the scored-table export with a row index column (O-6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from strata.operators.window import with_row_number


def with_row_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "F1") -> DataFrame:
    """1-based row index in a global order, computed without a single-partition window."""
    return with_row_number(df, order_by, out=name).select(name, *df.columns)


def export_scored(
    df: DataFrame,
    path: str,
    order_by: Sequence[str | Column],
    fmt: str = "csv",
    index_name: str = "F1",
) -> DataFrame:
    """Write the scored table (header, UTF-8, comma) with its row index.

    The files are written by every task in parallel; the index makes the
    global order recoverable by any reader without one ordered file.
    """
    out = with_row_index(df, order_by, index_name)
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").option("sep", ",").csv(path)
    else:
        writer.format(fmt).save(path)
    return out
