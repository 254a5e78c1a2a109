"""Committed exports: sorted files with a manifest (O-6).

An export is a folder of versions. Each write puts its files into a data folder
of its own and, last, one small manifest file that names them with their row
ranges. Readers see the newest manifest and only its files: an export that broke
off has files, but no manifest, and stays invisible; an older version is read
until the newer one is complete.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.sources.sinks import with_row_index

MANIFEST = "version long, data string, file string, format string, index string, rows long, first long, last long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of every committed version; no rows before the first commit."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def _write(df: DataFrame, target: str, fmt: str) -> None:
    writer = df.write.mode("error")
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").option("sep", ",").option("nullValue", "").option("emptyValue", '""').csv(target)
    else:
        writer.format(fmt).save(target)


def _read(spark: SparkSession, files: Sequence[str], fmt: str, schema: StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("encoding", "UTF-8").option("nullValue", "").option("mode", "FAILFAST").csv(list(files))
    return reader.format(fmt).load(list(files))


def _ranges(written: DataFrame, index: str) -> DataFrame:
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return written.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(index).alias("first"), F.max(index).alias("last"))


def _tiled(ranges: DataFrame) -> bool:
    """Whether the files hold 1, 2, 3, … without gap or overlap (a row per file)."""
    before = F.lag("last", 1, 0).over(Window.orderBy("first"))
    wrong = ranges.filter("rows > 0").withColumn("before", before).filter((F.col("first") != F.col("before") + 1) | (F.col("last") - F.col("first") + 1 != F.col("rows")))
    return wrong.isEmpty()


def export_committed(df: DataFrame, path: str, order_by: Sequence[str | Column], fmt: str = "csv", index: str = "F1") -> int:
    """Write ``df`` with a row index as the next version of the export at ``path``; its number.

    Rows get their place in the order of ``order_by`` (which must tell them
    apart); the files are written in parallel, each a sorted range of it. The
    written files are counted against the index before the commit. ``path`` is
    in a folder that the executors share.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    indexed = with_row_index(df, order_by, index)
    for ordered in (indexed.sortWithinPartitions(index), indexed.repartitionByRange(index).sortWithinPartitions(index)):
        data = f"data-{uuid.uuid4().hex}"
        _write(ordered, f"{path}/{data}", fmt)
        ranges = _ranges(_read(spark, [f"{path}/{data}"], fmt, indexed.schema), index)
        if _tiled(ranges):
            break
        # Where the index came by a shuffle join, its ranges are dealt out anew.
    else:
        raise RuntimeError(f"the files of {path}/{data} do not hold every row once")
    version = (manifest(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    rows = ranges.select(
        F.lit(version).cast("long").alias("version"), F.lit(data).alias("data"), "file", F.lit(fmt).alias("format"), F.lit(index).alias("index"), "rows", "first", "last"
    )
    # An export without rows has a version, too.
    none = spark.createDataFrame([(version, data, None, fmt, index, 0, None, None)], MANIFEST)
    # One file, so the version appears at once.
    rows.unionByName(none).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read_export(spark: SparkSession, path: str, schema: StructType, version: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """The rows of the newest (or a given) committed version.

    ``schema``: the columns with their index. With ``first`` and ``last`` only
    the files are opened whose range meets these row numbers.
    """
    path = path.rstrip("/")
    known = manifest(spark, path)
    newest = known.agg(F.max("version")).first()[0]
    version = newest if version is None else version
    # A row per file, and one for the version.
    files = known.filter(F.col("version") == F.lit(version)).collect()
    if not files:
        raise FileNotFoundError(f"{path} has no committed version{'' if version is None else f' {version}'}")
    index, fmt = files[0]["index"], files[0]["format"]
    lo, hi = first if first is not None else 1, last if last is not None else 2**63 - 1
    wanted = [f"{path}/{r['data']}/{r['file']}" for r in files if r["file"] is not None and r["rows"] and r["first"] <= hi and r["last"] >= lo]
    if not wanted:
        return spark.createDataFrame([], schema)
    rows = _read(spark, wanted, fmt, schema)
    return rows if first is None and last is None else rows.filter(F.col(index).between(lo, hi))
