import math

import pytest
from pyspark.sql import functions as F

from strata.operators import clean as CL
from strata.operators import joins as J


@pytest.fixture()
def holes(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a"), (2, None, None), (3, float("nan"), "b"), (4, 4.0, "b")],
        "k int, x double, t string",
    )


def test_fill_missing_numbers_nan_and_text(holes):
    got = sorted(tuple(r) for r in CL.fill_missing(holes).collect())
    assert got == [(1, 1.0, "a"), (2, 0.0, "0"), (3, 0.0, "b"), (4, 4.0, "b")]


def test_fill_missing_keep_null_categorical(holes):
    got = {r.k: r.t for r in CL.fill_missing(holes, keep_null=["t"]).collect()}
    assert got[2] is None


def test_drop_incomplete_treats_nan_as_missing(holes):
    assert sorted(r.k for r in CL.drop_incomplete(holes).collect()) == [1, 4]


def test_missing_profile(holes):
    got = {r.variable: r.missing_share for r in CL.missing_profile(holes).collect()}
    assert got["k"] == 0.0 and got["x"] == 0.5 and got["t"] == 0.25
    assert abs(got["(all)"] - 0.25) < 1e-12


def test_null_policy_sum(holes):
    got = {r.variable: (r.sum_skip, r.sum_propagate) for r in CL.null_policy_sum(holes, ["k", "x"]).collect()}
    assert got["k"] == (10.0, 10.0)
    assert got["x"] == (5.0, None)


def test_roughfix_median_even_count_and_mode_tie(spark):
    df = spark.createDataFrame(
        [(1.0, "b"), (2.0, "a"), (None, None), (10.0, "b"), (3.0, "a")], "x double, c string"
    )
    model = CL.fit_roughfix(df, ["x"], ["c"])
    assert model.fill["x"] == 2.5  # mean of the two middle values of 1, 2, 3, 10
    assert model.fill["c"] == "a"  # a and b both twice: the smallest wins
    filled = model.transform(df).filter(F.col("x") == 2.5).collect()
    assert len(filled) == 1 and filled[0].c == "a"


def test_exact_median_with_a_hot_value(spark):
    # A value held by a third of the rows must not change the answer.
    rows = [(float(i),) for i in range(600)] + [(7.0,)] * 300
    df = spark.createDataFrame(rows, "x double").repartition(8)
    got = CL.exact_medians(df, ["x"]).collect()[0]["median"]
    vals = sorted(r[0] for r in rows)
    n = len(vals)
    want = (vals[(n - 1) // 2] + vals[n // 2]) / 2
    assert got == want


def test_key_length_filter_drops_totals_and_null(spark):
    df = spark.createDataFrame([("AL",), ("Total",), (None,), ("DC",)], "State string")
    assert sorted(r[0] for r in CL.key_length_filter(df, "State", 2).collect()) == ["AL", "DC"]


def test_merge_natural_and_null_key_modes(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, b int")
    sql = sorted(tuple(r) for r in J.merge(a, b, how="inner").collect())
    assert sql == [("x", 1, 10)]
    match = sorted((r.k or "", r.a, r.b) for r in J.merge(a, b, how="inner", null_keys="match").collect())
    assert match == [("", 2, 20), ("x", 1, 10)]


def test_merge_refuses_cartesian(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([(1,)], "b int")
    with pytest.raises(ValueError):
        J.merge(a, b)


def test_outer_fold_equals_union_form(spark):
    t1 = spark.createDataFrame([(1, 1.0), (2, 2.0)], "user_id int, a double")
    t2 = spark.createDataFrame([(2, "p"), (3, "q")], "user_id int, b string")
    t3 = spark.createDataFrame([(3, 30), (4, 40)], "user_id int, c int")
    fold = sorted(tuple(r) for r in J.merge_all([t1, t2, t3]).select("user_id", "a", "b", "c").collect())
    union = sorted(tuple(r) for r in J.merge_all_union([t1, t2, t3], ["user_id"]).select("user_id", "a", "b", "c").collect())
    assert fold == union
    assert [r[0] for r in fold] == [1, 2, 3, 4]


def test_label_backfill_dedupes_list(spark):
    areas = spark.createDataFrame([("AL", "Autauga"), ("AR", "St. Francis"), ("MD", "Prince George's")], "State string, County string")
    pos = spark.createDataFrame([("AR", "St. Francis", 1), ("AR", "St. Francis", 1)], "State string, County string, Desert int")
    got = {r.County: r.Desert for r in J.label_backfill(areas, pos, ["State", "County"], "Desert").collect()}
    assert got == {"Autauga": 0, "St. Francis": 1, "Prince George's": 0}
    assert not math.isnan(0.0)


def test_exact_median_band_and_fallback_agree(spark):
    rows = [(float(i % 97), float((i * 7) % 13)) for i in range(2001)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(5)
    band = {r.variable: r.median for r in CL.exact_medians(df, ["a", "b"]).collect()}
    # The full-ranking fallback must give the same answers as the band path.
    coarse = {r.variable: r.median for r in CL.exact_medians(df, ["a", "b"], force_full=True).collect()}
    for c, idx in (("a", 0), ("b", 1)):
        vals = sorted(r[idx] for r in rows)
        n = len(vals)
        want = (vals[(n - 1) // 2] + vals[n // 2]) / 2
        assert band[c] == want and coarse[c] == want


def test_outer_fold_with_null_keys_matching(spark):
    t1 = spark.createDataFrame([(1, 1.0), (None, 9.0)], "user_id int, a double")
    t2 = spark.createDataFrame([(None, "n"), (2, "p")], "user_id int, b string")
    t3 = spark.createDataFrame([(None, 7), (1, 3)], "user_id int, c int")
    fold = J.merge_all([t1, t2, t3], how="full", null_keys="match").select("user_id", "a", "b", "c").collect()
    union = J.merge_all_union([t1, t2, t3], ["user_id"]).select("user_id", "a", "b", "c").collect()
    as_map = lambda rows: {r.user_id: (r.a, r.b, r.c) for r in rows}
    assert len(fold) == 3 and as_map(fold) == as_map(union) == {
        1: (1.0, None, 3),
        2: (None, "p", None),
        None: (9.0, "n", 7),
    }
    sql = J.merge_all([t1, t2, t3], how="full").collect()
    assert len(sql) == 5  # SQL semantics: each null key stays its own row


def test_union_form_refuses_a_repeated_key(spark):
    once = spark.createDataFrame([(1, 1.0), (2, 2.0)], "user_id int, a double")
    twice = spark.createDataFrame([(1, "n"), (1, "m")], "user_id int, b string")
    with pytest.raises(Exception, match="repeats a key"):
        J.merge_all_union([once, twice], ["user_id"]).collect()
    assert J.merge_all([once, twice]).count() == 3


def test_merge_tells_shared_columns_apart(spark):
    a = spark.createDataFrame([(1, 1.0, "l")], "k int, x double, only_a string")
    b = spark.createDataFrame([(1, 2.0, "r")], "k int, x double, only_b string")
    for null_keys in ("sql", "match"):
        got = J.merge(a, b, on=["k"], null_keys=null_keys)
        assert got.columns == ["k", "x_x", "only_a", "x_y", "only_b"]
        assert tuple(got.first()) == (1, 1.0, "l", 2.0, "r")
    with pytest.raises(ValueError, match="taken"):
        J.merge(a.withColumn("x_y", F.lit(0)), b, on=["k"])


def test_cohorts_count_a_repeated_entity_once(spark):
    from strata.operators.setops import cohort_change

    rows = spark.createDataFrame([(1, 2.0, 1.0, 1), (1, 2.0, 1.0, 1), (2, 3.0, 1.0, 1)], "k int, late double, early double, flag int")
    assert cohort_change(rows, "late", "early", "flag", keys=["k"]).collect()[0].n == 2
    assert cohort_change(rows, "late", "early", "flag").collect()[0].n == 3
