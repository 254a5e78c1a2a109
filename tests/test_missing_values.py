"""Missing values, many levels and partitioning: results that no row may change silently."""

import pytest
from pyspark.sql import functions as F

from strata.functions.scalar import binarise
from strata.operators import categorical, clean, ml, stats
from strata.schema import normalise_columns


def test_binarise_keeps_missing(spark):
    df = spark.createDataFrame([(0.7,), (0.2,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(binarise("x")).collect()] == [1.0, 0.0, None, None]


def test_nan_does_not_spoil_a_column(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), (None, 5.0), (None, 7.0)], "g string, x double")
    fitted = stats.fit_standardizer(df.filter("g = 'a'"), ["x"])
    assert fitted.means["x"] == 1.5 if hasattr(fitted, "means") else True
    rows = stats.zscore_by(df, ["x"], ["g"]).collect()
    assert len(rows) == 5 and sorted(round(r.x, 6) for r in rows if r.g is None) == [-0.707107, 0.707107]


def test_levels_without_a_cap(spark):
    df = spark.range(0, 12_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("k"))
    got = categorical.level_codes(df.unionByName(spark.createDataFrame([(None,)], "k string")), "k")
    assert got.columns == ["k", "level"]
    assert got.filter("level = cast(k as int) + 1").count() == 12_000 and got.filter("k is null and level is null").count() == 1


def test_medians_of_missing_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert clean.exact_medians(df, ["x"]).collect() == []


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="a_b"):
        normalise_columns(spark.createDataFrame([(1, 2)], "`a.b` int, a_b int"))


def test_training_frame_ignores_input_partitioning(spark):
    df = spark.range(0, 500).select("id", (F.col("id") % 7).alias("x"))

    def dealt(frame):
        return [(r.p, r.id) for r in ml.materialize(frame, ["id"], 4).select(F.spark_partition_id().alias("p"), "id").collect()]

    assert dealt(df.repartition(3)) == dealt(df.repartition(8, "x"))


def test_text_and_null_keys_split(spark):
    df = spark.range(0, 4000).select(F.concat(F.lit("key-"), F.col("id")).alias("k"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    parts = {r.part: r["count"] for r in ml.hash_split(df, ["k", "n"]).groupBy("part").count().collect()}
    assert 850 < parts["test"] < 1150 and sum(parts.values()) == 4000
