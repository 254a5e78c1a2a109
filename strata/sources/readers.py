"""Sources: CSV with declared or inferred schema, parquet tables, label lists.

CSV is row-based and cannot push filters into the file, so the intended use
at scale is ``to_parquet_once`` right after the first read; every later
query scans the columnar copy (vectorised reader, pushed filters, pruned
columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strata.schema import normalise_columns


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    view: str | None = None,
    normalise: bool = True,
) -> DataFrame:
    """CSV scan (O-1 / O-2).

    A declared schema is the default path; type inference is only a fallback
    because it costs an extra pass over the files. A UTF-8 byte-order mark on
    the first header cell is stripped by name normalisation.
    """
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    reader = reader.option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    df = reader.csv(path)
    if normalise:
        df = normalise_columns(df)
    if view:
        register_view(df, view)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the test layout: ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_label_list(
    spark: SparkSession,
    path: str,
    keys: list[str],
    label: str,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Positive-only label list (O-3): one row per member key.

    Duplicated members are collapsed so a later left join never multiplies
    rows; the label column is kept as integer 0/1.
    """
    df = read_csv(spark, path, schema=schema)
    return df.select(*keys, F.col(label).cast("int").alias(label)).dropDuplicates(keys)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """``sdf_copy_to(..., overwrite=TRUE)`` (O-4): data stays distributed."""
    df.createOrReplaceTempView(name)
    return df


def to_parquet_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a source once as parquet so later scans are columnar and prunable."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
