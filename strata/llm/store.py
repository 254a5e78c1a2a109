"""Tables in the cluster's shared folder."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint_dir, ship  # noqa: F401 - operators take ship from here

# Rows (of 8-byte keys) up to which a key list is broadcast: 2M x 8 B = 16 MB.
BROADCAST_KEYS = 2_000_000
# Whole texts that go to a Python worker at a time: some MB, while Spark's 10,000 rows hold tens of MB
# in the executor and in the worker.
TEXT_ROWS, ARROW_ROWS = 500, "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside send at most TEXT_ROWS rows to a worker at a time (fewer, if the session says so)."""
    before = spark.conf.get(ARROW_ROWS)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but later readers prune columns.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_keys(df: DataFrame, keys: DataFrame, on: str, anti: bool = False) -> DataFrame:
    """Semi (anti) join with a key list whose size is counted before it is broadcast.

    Beyond BROADCAST_KEYS the planner's shuffle join is used; results are equal.
    """
    keys = materialize(keys.select(on).distinct(), "keys")
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return df.join(side, on, "left_anti" if anti else "left_semi")


def sample_keys(keys: DataFrame, on: str, n: int, salt: str) -> DataFrame:
    """At most ``n`` distinct keys, the least by a hash: (``on``, order), written.

    The choice follows from the keys alone. Before one task sorts them, the keys
    are cut at the hash that ``n`` and six standard deviations of them pass, so
    that task gets about ``n`` rows whatever the input. Where keys repeat, the
    cut counts rows, and somewhat fewer keys may be chosen. Null keys never are.
    """
    order = F.shiftrightunsigned(F.xxhash64(F.col(on).cast("string"), F.lit(salt)), 1)
    known = materialize(keys.select(on).filter(F.col(on).isNotNull()).withColumn("order", order), "keys")
    total = known.count()
    share = (n + 6 * math.sqrt(n) + 10) / max(total, 1)
    if share < 1:
        known = known.filter(F.col("order") < F.lit(int(share * 2**63)))
    return materialize(known.distinct().orderBy("order", on).limit(n), "sample")


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores as no column of the tables has (names differ in more than case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
