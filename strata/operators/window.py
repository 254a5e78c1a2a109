"""Window-style operators (O-44 … O-47) and the global ordering helper.

``with_row_number`` is the building block for every operator that needs a
position in a *global* order (deciles, exact medians, tie-averaged ranks,
exported row index, local-regression bandwidths). A plain
``row_number().over(Window.orderBy(...))`` is planned as
``Exchange SinglePartition``: every row goes through one task. Instead:

1. ``repartitionByRange`` on (groups…, order…) spreads the rows over many
   partitions; equal sort keys always land in the same partition;
2. ``sortWithinPartitions`` orders each partition;
3. ``monotonically_increasing_id`` encodes (partition id << 33) + position,
   so the position inside the partition is read back without a UDF;
4. the tagged frame is checkpointed (reliable storage) so partition ids
   and positions are fixed once;
5. a per-(partition, group) count table — at most partitions + groups rows,
   independent of the data size — gives each partition's offset through a
   small window; it is materialized, measured, and broadcast back when
   within ``MAX_BROADCAST_BYTES`` (else joined with a shuffle).

The result equals ``row_number()`` over the same order (ties are broken
arbitrarily, as ``row_number`` does; pass a unique tie key for a stable
order). It is meant for a *few large* groups (models, variables, grid
points); for many small groups a partitioned window is already parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from strata.session import checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id keeps the record number in the low 33 bits


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_row_number(
    df: DataFrame,
    order_by: Sequence[str | Column],
    partition_by: Sequence[str] = (),
    out: str = "rn",
    num_partitions: int | None = None,
    split_ties: bool = False,
    size_col: str | None = None,
) -> DataFrame:
    """Add a 1-based ``out`` column = row_number within ``partition_by`` in ``order_by`` order.

    ``size_col`` also adds the group's row count, read from the same small
    count table (no second pass over the data).

    ``split_ties`` appends the input record id to the sort key, so one value
    held by a third of all rows is spread over several range partitions
    instead of landing in one task. Use it when only the *value* at a rank
    matters (medians, bandwidths), not which of the tied rows gets it.
    """
    parts = list(partition_by)
    keys = [F.col(p) for p in parts] + [_as_col(c) for c in order_by]
    if split_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        keys.append(F.col("_tie"))
    # Without an explicit count the range exchange starts from
    # spark.sql.shuffle.partitions and AQE may merge adjacent ranges (order is
    # kept) to its advisory partition size: few tasks for small inputs, many
    # for large ones.
    repart = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = (
        repart
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn(
            "_pos",
            F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), _POS_BITS),
        )
    )
    # Both branches below (counts and rows) must see the same partition
    # assignment. Range bounds come from sampling the input, and an input
    # produced by a shuffle has no fixed row order, so two evaluations can
    # disagree. A reliable checkpoint pins partition ids and positions once
    # (and cuts the lineage, so a lost executor re-reads files instead of
    # re-running the sort).
    checkpoint_dir(df.sparkSession)
    ranged = ranged.checkpoint(eager=True)
    # One row per (partition, group): bounded by partitions + groups, not by rows.
    counts = ranged.groupBy("_pid", *parts).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*parts).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_cnt").over(Window.partitionBy(*parts)).alias(size_col)] if size_col else []
    offsets = counts.select(
        "_pid", *parts, "_first", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"), *extra
    )
    joined = join_on_groups(ranged, bounded_broadcast(offsets), ["_pid", *parts])
    return joined.withColumn(out, F.col("_off") + F.col("_pos") - F.col("_first") + F.lit(1)).drop(
        "_pid", "_pos", "_first", "_off", "_tie"
    )


# Largest side, in bytes, that is broadcast after measuring it; beyond it a
# shuffle join is used.
MAX_BROADCAST_BYTES = 32 << 20


def bounded_broadcast(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Materialize a side expected to be small, measure it, and hint a broadcast
    only when rows times row width stay within ``max_bytes`` (else return it
    unhinted, so the planner uses a shuffle join). The checkpoint makes the
    measured rows exactly the rows that are joined. Text and nested columns
    count 64 bytes each, all others 8."""
    checkpoint_dir(small.sparkSession)
    fixed = small.checkpoint(eager=True)
    width = sum(64 if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType)) else 8 for f in fixed.schema)
    max_rows = max_bytes // width
    return F.broadcast(fixed) if fixed.limit(max_rows + 1).count() <= max_rows else fixed


def join_on_groups(df: DataFrame, per_group: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Attach one row per group to the rows of ``df``; a null group meets its own row."""
    side = per_group.withColumnsRenamed({g: f"_of_{g}" for g in groups})
    on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_of_{g}")) for g in groups])
    return df.join(side, on, "inner").drop(*[f"_of_{g}" for g in groups])


def ntile_from_row_number(rn: Column, n: Column, buckets: int) -> Column:
    """SQL ``ntile`` from a 1-based row number and the group size.

    The first ``n mod buckets`` buckets get one extra row, as ``ntile`` does.
    """
    q = F.floor(n / buckets).cast("long")
    r = (n % buckets).cast("long")
    big = r * (q + 1)
    head = F.floor((rn - 1) / (q + 1)).cast("long") + 1
    tail = r + F.floor((rn - big - 1) / F.greatest(q, F.lit(1))).cast("long") + 1
    return F.when(rn <= big, head).otherwise(tail).cast("int")


def ntile_by(
    df: DataFrame,
    order_by: Sequence[str | Column],
    buckets: int = 10,
    partition_by: Sequence[str] = (),
    out: str = "bin",
) -> DataFrame:
    """``ntile(buckets)`` over a global order per group without a single-partition window (O-45)."""
    parts = list(partition_by)
    if not parts:
        df, parts = df.withColumn("_all", F.lit(0)), ["_all"]
    numbered = with_row_number(df, order_by, parts, out="_rn", size_col="_n")
    out_df = numbered.withColumn(out, ntile_from_row_number(F.col("_rn"), F.col("_n"), buckets))
    return out_df.drop("_rn", "_n", "_all")


def share_of_total(df: DataFrame, value: str, out: str = "prop", partition_by: Sequence[str] = ()) -> DataFrame:
    """``count / sum(count)`` (O-46); meant for already-aggregated small frames."""
    w = Window.partitionBy(*partition_by)
    return df.withColumn(out, F.col(value) / F.sum(value).over(w))


def running_sum(df: DataFrame, value: str, order_by: str, out: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``cumsum`` ordered by ``order_by`` (O-47); for aggregated frames (bins, years)."""
    w = Window.partitionBy(*partition_by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def group_totals_window(
    df: DataFrame, groups: Sequence[str], sums: dict[str, str], count_name: str | None = None
) -> DataFrame:
    """O-44 literal form: group totals attached to each row (``mutate`` under
    ``group_by``), then de-duplicated (``unique``).

    Not written as ``sum().over(partitionBy(g))``: a window puts every row of
    a group into one task, so a group holding a third of the data would be
    one task. The same rows come from a partial/final aggregate joined back on
    the group keys (one row per group, broadcast by AQE when small; the skew
    join split applies otherwise) followed by a map-side-combined distinct.
    """
    aggs = [F.sum(src).alias(name) for name, src in sums.items()]
    if count_name:
        aggs.append(F.count(F.lit(1)).alias(count_name))
    totals = df.groupBy(*groups).agg(*aggs)
    return join_on_groups(df.select(*groups), totals, list(groups)).distinct()
