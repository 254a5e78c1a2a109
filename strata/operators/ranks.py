"""Exact order statistics without sorting or moving rows.

Every pass counts the cells of the intervals that hold a wanted rank and keeps
those cells only, until a cell holds a single value: two or three passes for
most columns. Counts, least and greatest values add up in any order, so nothing
depends on the partitions, and a value held by a third of the rows is one cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import ship

# Cells that an interval is cut into while a rank is searched.
CELLS = 1024
_MOST = float(np.finfo(np.float64).max)

Ranks = Sequence[int] | Callable[[int], Sequence[int]]


def doubles(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as doubles; null becomes NaN."""
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _count_cells(intervals: dict[str, list[tuple[float, float]]]):
    """Rows and value range of each cell of each interval of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(intervals)
        sizes = [len(intervals[c]) * CELLS for c in names]
        n = [np.zeros(s, dtype=np.int64) for s in sizes]
        low, high = [np.full(s, np.inf) for s in sizes], [np.full(s, -np.inf) for s in sizes]
        for batch in batches:
            for i, c in enumerate(names):
                x = doubles(batch, c)
                x = x[~np.isnan(x)]
                lows, highs = np.array(intervals[c]).T
                at = np.searchsorted(lows, x, side="right") - 1
                inside = (at >= 0) & (x <= highs[at])
                x, at = x[inside], at[inside]
                # Halves keep the widest ranges finite; infinite values have the outermost cells to themselves.
                near, far = np.maximum(lows, -_MOST) / 2, np.minimum(highs, _MOST) / 2
                wide = far - near
                cell = np.floor((np.clip(x, -_MOST, _MOST) / 2 - near[at]) / np.where(wide > 0, wide, 1.0)[at] * CELLS)
                cell = np.clip(cell, np.isneginf(lows)[at], CELLS - 1 - np.isposinf(highs)[at]).astype(np.int64)
                cell = at * CELLS + np.where(np.isinf(x), np.where(x < 0, 0, CELLS - 1), cell)
                n[i] += np.bincount(cell, minlength=sizes[i])
                np.minimum.at(low[i], cell, x)
                np.maximum.at(high[i], cell, x)
        for i, c in enumerate(names):
            some = np.flatnonzero(n[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[i][some], pa.int64()), pa.array(low[i][some]), pa.array(high[i][some])],
                names=["name", "cell", "n", "low", "high"],
            )

    return run


def order_statistics(df: DataFrame, ranks: dict[str, Ranks]) -> dict[str, dict[int, float]]:
    """Values at 1-based ranks of each column: {column: {rank: value}}.

    Ranks may be a function of the number of values. Null and NaN are no values;
    ranks beyond them are left out.
    """
    ship(df.sparkSession)
    columns = list(ranks)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    finite = [F.when(~F.isnan(F.col(c)), F.col(c)) for c in columns]
    row = data.agg(
        *[f(x).alias(f"{i}{name}") for i, x in enumerate(finite) for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    found: dict[str, dict[int, float]] = {c: {} for c in columns}
    wanted: dict[str, list[int]] = {}
    # (low, high, rows below) of the intervals still open.
    open_: dict[str, list[tuple[float, float, int]]] = {}
    for i, c in enumerate(columns):
        n, given = row[f"{i}n"], ranks[c]
        wanted[c] = [k for k in (given(n) if callable(given) else given) if 1 <= k <= n]
        if wanted[c]:
            open_[c] = [(row[f"{i}lo"], row[f"{i}hi"], 0)]
    while open_:
        intervals = {c: [(lo, hi) for lo, hi, _ in iv] for c, iv in open_.items()}
        counted = data.select(*open_).mapInArrow(_count_cells(intervals), "name string, cell long, n long, low double, high double")
        # Intervals x CELLS rows at most.
        cells = counted.groupBy("name", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("name", "cell").collect()
        after: dict[str, list[tuple[float, float, int]]] = {}
        passed: dict[tuple[str, int], int] = {}
        for r in cells:
            c, which = r["name"], r["cell"] // CELLS
            below = passed.get((c, which), open_[c][which][2])
            passed[c, which] = below + r["n"]
            inside = [k for k in wanted[c] if below < k <= below + r["n"]]
            if inside and r["low"] == r["high"]:
                found[c].update(dict.fromkeys(inside, r["low"]))
            elif inside:
                after.setdefault(c, []).append((r["low"], r["high"], below))
        open_ = after
    return found
