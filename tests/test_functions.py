import math

from pyspark.sql import functions as F

from strata.functions import scalar as S


def test_recode_keeps_unmatched(spark):
    df = spark.createDataFrame([(1,), (0,), (7,), (None,)], "v int")
    out = [r[0] for r in df.select(S.recode("v", {1: "Desert", 0: "NonDesert"})).collect()]
    assert out == ["Desert", "NonDesert", "7", None]


def test_binarise_is_strict(spark):
    df = spark.createDataFrame([(0.5,), (0.5000001,), (0.1,)], "p double")
    assert [r[0] for r in df.select(S.binarise("p", 0.5)).collect()] == [0.0, 1.0, 0.0]


def test_fixed_bin_float_edge_and_closed_top(spark):
    df = spark.createDataFrame([(0.3,), (0.0,), (0.99,), (1.0,)], "p double")
    plain = [r[0] for r in df.select(S.fixed_bin("p", 0.1)).collect()]
    # floor(0.3 / 0.1) is 2 in IEEE arithmetic; 1.0 lands in bin 10.
    assert plain == [2, 0, 9, 10]
    closed = [r[0] for r in df.select(S.fixed_bin("p", 0.1, top_bin=9)).collect()]
    assert closed == [2, 0, 9, 9]


def test_paste_prints_na(spark):
    df = spark.createDataFrame([("1", "Rural"), (None, "Urban")], "a string, b string")
    assert [r[0] for r in df.select(S.paste("a", "b")).collect()] == ["1-Rural", "NA-Urban"]


def test_to_number_bad_text_is_null(spark):
    df = spark.createDataFrame([("12.5",), ("<Null>",), ("",)], "t string")
    assert [r[0] for r in df.select(S.to_number("t")).collect()] == [12.5, None, None]


def test_safe_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_ratio("a", "b")).collect()] == [None, 2.5]


def test_strip_prefix_once(spark):
    df = spark.createDataFrame([("pop2015",), ("poppop1",)], "v string")
    assert [r[0] for r in df.select(S.strip_prefix("v", "pop")).collect()] == ["2015", "pop1"]


def test_label_if_and_attr(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 1.0), ("B", 1.0), ("B", 2.0)], "g string, p double")
    got = {r[0]: r[1] for r in df.groupBy("g").agg(S.attr("p")).collect()}
    assert got == {"A": 1.0, "B": None}
    lab = [r[0] for r in df.select(S.label_if(F.col("p") > 1.5, "g")).collect()]
    assert lab == ["", "", "", "B"]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert [r[0] for r in df.select(S.nan_to_null("v")).collect()] == [None, 1.0]
    assert not math.isnan(1.0)
