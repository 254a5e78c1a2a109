"""Default aggregates of a drill path, class samples, factors."""

import math

import pytest
from pyspark.sql import functions as F

from strata.operators import categorical as C
from strata.operators import clean as CL
from strata.operators import profile as P
from strata.operators import stats as ST


def test_drill_path_by_default_aggregates(spark):
    rows = [("A", "x", 1.0, "u", 5, 2.0), ("A", "x", math.nan, "u", 7, 4.0), ("A", "y", 3.0, None, None, 9.0), (None, "y", 4.0, "w", 1, None), ("B", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "State string, County string, total double, name string, n int, rate double")
    df = P.with_aggregate(df, rate="mean", name="attr")
    assert [P.default_aggregate(df.schema[c]) for c in ("total", "n", "rate", "name", "County")] == ["sum", "sum", "mean", "attr", "count"]
    out = P.drill_path(df, ["State", "County"])
    got = {(r.level, r.State, r.County): (r.records, r.total, r["name"], r.n, r.rate) for r in out.collect()}
    assert got == {
        (0, "A", "x"): (2, 1.0, "u", 12, 3.0), (0, "A", "y"): (1, 3.0, None, None, 9.0), (0, None, "y"): (1, 4.0, "w", 1, None), (0, "B", None): (1, None, None, None, None),
        (1, "A", None): (3, 4.0, "u", 12, 5.0), (1, None, None): (1, 4.0, "w", 1, None), (1, "B", None): (1, None, None, None, None),
        (3, None, None): (5, 8.0, None, 13, 5.0),
    }
    # Rows are shuffled once for the path; what is rolled up is one row per path.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("Aggregate")
    with pytest.raises(ValueError):
        P.drill_path(P.with_aggregate(df, n="median"), ["State"])


def test_sample_by_class_is_exact_and_stable(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 50 == 1, "b").when(F.col("id") == 5, None).otherwise("c").alias("g"))
    sizes = {r.g: r["count"] for r in df.groupBy("g").count().collect()}

    def taken(frame, k):
        return {(r.g, r.id): (r.class_rows, r.rate) for r in ST.sample_by_class(frame, ["g"], ["id"], k).collect()}

    got = taken(df, 70)
    for g, n in sizes.items():
        own = [v for (c, _), v in got.items() if c == g]
        assert len(own) == min(70, n) and set(own) == {(n, min(1.0, 70 / n))}
    assert taken(df.repartition(9), 70) == got
    assert set(taken(df, 20)) < set(got)
    assert ST.sample_by_class(df.limit(0), ["g"], ["id"], 5).collect() == []


def test_factor_without_the_level_stays_missing(spark):
    df = spark.createDataFrame([("0", "x", "p"), (None, None, None), ("2", "y", "q")], "flag string, kind string, word string")
    f = C.as_factor(C.as_factor(df, "flag", ["0", "1"]), "kind")
    assert f.schema["flag"].metadata["levels"] == ["0", "1"] and f.schema["kind"].metadata["levels"] == ["x", "y"]
    filled = CL.fill_missing(f)
    assert sorted(map(tuple, filled.collect()), key=repr) == sorted([("0", "x", "p"), ("0", None, "0"), ("0", "y", "q")], key=repr)
    assert CL.drop_incomplete(filled).count() == 2
