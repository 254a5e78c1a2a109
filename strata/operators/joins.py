"""Equi-joins with R ``merge`` semantics (O-31, O-35 … O-38).

``merge`` joins on all common column names, coalesces the key columns, and
matches NA keys to NA keys. ``null_keys='sql'`` keeps SQL semantics (null
never matches); ``'match'`` uses null-safe equality (``<=>``), which Spark
still plans as a sort-merge / hash join on (coalesce, isnull) keys — no
cartesian product.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    right = set(b.columns)
    return [c for c in a.columns if c in right]


def merge(
    a: DataFrame,
    b: DataFrame,
    on: Sequence[str] | None = None,
    how: str = "inner",
    null_keys: str = "sql",
) -> DataFrame:
    """Natural (or named-key) join (O-35, O-36, O-37, O-38 step).

    A column that both sides have beside the keys comes out twice, as
    ``<name>_x`` (left) and ``<name>_y`` (right).
    """
    keys = list(on) if on else common_columns(a, b)
    if not keys:
        raise ValueError("no common columns to join on; refusing to build a cartesian product")
    twice = [c for c in common_columns(a, b) if c not in keys]
    taken = {f"{c}_{side}" for c in twice for side in "xy"} & {*a.columns, *b.columns}
    if taken:
        raise ValueError(f"suffixed names are taken: {sorted(taken)}")
    a = a.withColumnsRenamed({c: f"{c}_x" for c in twice})
    b = b.withColumnsRenamed({c: f"{c}_y" for c in twice})
    if null_keys == "sql":
        return a.join(b, on=keys, how=how)
    if null_keys != "match":
        raise ValueError("null_keys must be 'sql' or 'match'")
    la, rb = a.alias("_l"), b.alias("_r")
    cond = reduce(lambda x, y: x & y, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) for k in keys])
    j = la.join(rb, cond, how)
    key_cols = [F.coalesce(F.col(f"_l.{k}"), F.col(f"_r.{k}")).alias(k) for k in keys]
    rest_a = [F.col(f"_l.{c}") for c in a.columns if c not in keys]
    rest_b = [F.col(f"_r.{c}") for c in b.columns if c not in keys]
    return j.select(*key_cols, *rest_a, *rest_b)


def merge_all(tables: Sequence[DataFrame], how: str = "full", null_keys: str = "sql") -> DataFrame:
    """``Reduce(merge(..., all=TRUE))`` over N tables (O-38), literal fold.

    Common columns are recomputed at each step, as the reference does. Each
    step is one shuffle join; prefer ``merge_all_union`` when every table has
    unique keys.
    """
    return reduce(lambda x, y: merge(x, y, how=how, null_keys=null_keys), tables)


def merge_all_union(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Same result as the full-outer fold when keys are unique per table (O-38).

    ``unionByName(allowMissingColumns)`` + one ``groupBy(keys)``: a single
    shuffle on the key instead of one per table, and the per-table partial
    aggregate means a hot key ships one row per task. Null keys form one
    group, i.e. NA matches NA as in ``merge``.

    A key that a table holds twice has no single row here: the job fails and
    says so, in the same aggregate (up to 63 tables). Use ``merge_all`` then.
    """
    if len(tables) > 63:
        raise ValueError("at most 63 tables")
    marked = [t.withColumn("__table", F.lit(1 << i).cast("long")) for i, t in enumerate(tables)]
    stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), marked)
    values = [c for c in stacked.columns if c not in {*keys, "__table"}]
    rows = stacked.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in values], F.count(F.lit(1)).alias("__rows"), F.bit_or("__table").alias("__tables")
    )
    unique = F.col("__rows") == F.bit_count("__tables")
    repeated = F.raise_error(F.lit("merge_all_union: a table repeats a key")).cast("boolean")
    return rows.filter(F.when(unique, F.lit(True)).otherwise(repeated)).drop("__rows", "__tables")


def label_backfill(
    df: DataFrame, positives: DataFrame, keys: Sequence[str], label: str, fill: int = 0
) -> DataFrame:
    """Positive-only list -> 0/1 label on every row (O-31, O-3, O-37).

    The list is reduced to distinct member keys (a repeated member never
    duplicates rows); the left join then needs no further shuffle on that
    side, and AQE broadcasts it at run time when it turns out small.
    """
    members = positives.select(*keys).distinct().withColumn(label, F.lit(1))
    joined = df.join(members, on=list(keys), how="left")
    return joined.withColumn(label, F.coalesce(F.col(label), F.lit(fill)).cast("int"))
