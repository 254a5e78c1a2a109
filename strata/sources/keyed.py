"""Tables stored by key: bucketed and sorted, so that merges on the key move no rows (O-4, O-38)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir


def store_keyed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, folder: str | None = None, overwrite: bool = False) -> str:
    """Write ``df`` as the table ``name``, dealt into ``buckets`` by ``keys`` and sorted by them.

    One shuffle, once; every later join or aggregate on the keys of tables with
    as many buckets reads them where they lie. The keys are columns that
    identify a row: a null or repeated one is refused, after a check of the
    stored table that itself moves no rows. ``folder`` is a shared one (default:
    a new one beside the checkpoints). Returns the table's name.
    """
    spark = df.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/keyed-{uuid.uuid4().hex[:12]}"
    writer = df.repartition(buckets, *keys).write.format("parquet").option("path", f"{folder.rstrip('/')}/{name}")
    writer.mode("overwrite" if overwrite else "error").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    stored = spark.table(name)
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    bad = stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | missing)
    if not bad.isEmpty():
        spark.sql(f"DROP TABLE `{name}`")
        raise ValueError(f"{name}: a key is null or repeated")
    return name


def store_spine(spark: SparkSession, names: Sequence[str], name: str, keys: Sequence[str], buckets: int, folder: str | None = None) -> str:
    """Store the distinct keys of stored tables as a table of the same buckets: the rows of their outer merge.

    Only key columns move, once.
    """
    every = reduce(lambda a, b: a.union(b), [spark.table(n).select(*keys) for n in names])
    # A union of bucketed scans claims their buckets but lines its parts up one
    # after the other (Spark 4.1): a distinct on top of it would miss copies.
    setting = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(setting, "true")
    spark.conf.set(setting, "false")
    try:
        return store_keyed(every.distinct(), name, keys, buckets, folder)
    finally:
        spark.conf.set(setting, before)


def merge_stored(spark: SparkSession, names: Sequence[str], keys: Sequence[str], spine: str) -> DataFrame:
    """Full outer merge of tables stored by the same keys in as many buckets (O-38).

    Each table is joined to their spine where its buckets lie: no row moves. (A
    full outer join after another would lose track of the partitioning and
    shuffle again.) Equal to ``joins.merge_all(..., "full")``. Columns beside
    the keys must differ between the tables.
    """
    tables = [spark.table(n) for n in names]
    seen: set[str] = set()
    for t in tables:
        twice = seen & (set(t.columns) - set(keys))
        if twice:
            raise ValueError(f"columns in two tables: {sorted(twice)}")
        seen |= set(t.columns)
    # Sort-merge: the buckets of both sides already lie together, whatever their size.
    return reduce(lambda a, t: a.join(t.hint("merge"), list(keys), "left"), tables, spark.table(spine).select(*keys))
