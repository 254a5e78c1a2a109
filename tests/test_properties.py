"""Property tests: the distributed global-order helper equals Spark's
single-partition window functions on random inputs with heavy ties."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators import window as W

rows_strategy = st.lists(
    st.tuples(st.integers(0, 2), st.integers(0, 5)),  # (group, score): few distinct values -> many ties
    min_size=1,
    max_size=60,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 6), buckets=st.integers(1, 12))
def test_ntile_equals_window_ntile(spark, rows, parts, buckets):
    data = [(g, float(s), i) for i, (g, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "g int, s double, k int").repartition(parts)
    order = [F.col("s").desc(), F.col("k").asc()]
    mine = {r.k: r.b for r in W.ntile_by(df, order, buckets, ["g"], "b").collect()}
    ref = {r.k: r.b for r in df.withColumn("b", F.ntile(buckets).over(Window.partitionBy("g").orderBy(*order))).collect()}
    assert mine == ref


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, parts=st.integers(1, 6))
def test_split_ties_keeps_the_value_at_each_rank(spark, rows, parts):
    data = [(g, float(s)) for g, s in rows]
    df = spark.createDataFrame(data, "g int, s double").repartition(parts)
    got = sorted((r.g, r.rn, r.s) for r in W.with_row_number(df, ["s"], ["g"], out="rn", split_ties=True).collect())
    want = []
    for g in sorted({g for g, _ in data}):
        vals = sorted(s for gg, s in data if gg == g)
        want += [(g, i + 1, v) for i, v in enumerate(vals)]
    assert got == want
