"""CSV with a reject side (O-1, O-2).

Files are read as lines, so that every record keeps its file and line; a record
that does not fit the declared schema goes to the reject side with the reason,
instead of turning into nulls. Records are lines: quoted fields may hold
separators, but no line breaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strata.operators.window import bounded_broadcast
from strata.schema import normalise_name

_BAD = "_bad_record"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(value, file, block, at): lines with their place, blocks in order of ``block``."""
    lines = spark.read.option("encoding", encoding).text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def _placed(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``line``, the 1-based number of the record in its file.

    A task reads a block of a file line after line; how many lines the blocks
    before hold comes from a count per block.
    """
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = wanted.join(bounded_broadcast(offsets), ["file", "block"])
    return joined.withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)


def read_csv_checked(
    spark: SparkSession, path: str, schema: StructType, sep: str = ",", encoding: str = "UTF-8", header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a declared schema.

    ``rows`` holds the records of which every field is empty or can be cast to
    its declared type; names are normalised (the original stays as metadata).
    ``rejects``: (file, line, reason, record), the reason a number of fields
    other than declared, or the columns whose text does not fit. Empty lines are
    no records. With ``header`` the first line of each file is left out.
    """
    lines = _lines(spark, path, encoding)
    records = lines.filter(F.length(F.trim("value")) > 0)
    if header:
        # A file's first line stands at the start of its first block.
        heads = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("head"))
        records = records.join(bounded_broadcast(heads), "file", "left").filter(F.col("head").isNull() | (F.col("at") != F.col("head"))).drop("head")
    # Fields are cut first and cast after, so that each can be told apart.
    texts = StructType([*(StructField(f"c{i}", StringType()) for i in range(len(schema.fields))), StructField(_BAD, StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = F.from_csv(F.regexp_replace("value", "^\\uFEFF", ""), texts.simpleString()[7:-1].replace(":", " "), options)
    # Generated, a record is parsed once for all its fields; projected, it would be parsed anew for each.
    cut = records.select(*records.columns, F.explode(F.array(parsed)).alias("r"))
    typed, misfits = [], []
    for i, f in enumerate(schema.fields):
        text = F.col(f"r.c{i}")
        value = text if isinstance(f.dataType, StringType) else text.try_cast(f.dataType)
        typed.append(value.alias(normalise_name(f.name), metadata={**(f.metadata or {}), "source_name": f.name}))
        misfits.append(F.when(text.isNotNull() & (F.length(text) > 0) & value.isNull(), F.lit(f.name)))
    short = F.col(f"r.{_BAD}").isNotNull()
    wrong = F.array_compact(F.array(*misfits))
    reason: Column = F.when(short, F.lit(f"not {len(schema.fields)} fields")).when(F.size(wrong) > 0, F.concat(F.lit("does not fit: "), F.array_join(wrong, ", ")))
    judged = cut.withColumn("reason", reason)
    rows = judged.filter("reason is null").select(*typed)
    rejects = _placed(lines, judged.filter("reason is not null").select("file", "block", "at", "reason", "value"))
    return rows, rejects.select(F.element_at(F.split("file", "/"), -1).alias("file"), "line", "reason", F.col("value").alias("record"))
