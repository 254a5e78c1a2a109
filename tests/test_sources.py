"""Stored tables, checked CSV and committed exports."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import joins as J
from strata.sources import SCORED_SCHEMA, export_committed, manifest, merge_stored, read_csv_checked, read_export, store_keyed, store_spine


def fresh(name):
    return f"{name}_{uuid.uuid4().hex[:8]}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_merge_without_an_exchange(spark):
    frames = [spark.range(i * 10, 200 + i * 30).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * i).alias(f"v{i}")) for i in range(8)]
    names = [store_keyed(f.repartition(3), fresh("t"), ["k", "g"], 6) for f in frames]
    merged = merge_stored(spark, names, ["k", "g"], store_spine(spark, names, fresh("s"), ["k", "g"], 6))
    assert "Exchange" not in plan(merged) and plan(merged).count("SortMergeJoin") == 8
    want = J.merge_all(frames, how="full").select(*merged.columns)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, want.collect()))
    # An aggregate on the keys of a stored table moves no rows either.
    assert "Exchange" not in plan(spark.table(names[0]).groupBy("k", "g").count())


def test_stored_keys_identify_rows(spark):
    for rows in ([(1, 2), (1, 3)], [(1, 2), (None, 3)]):
        name = fresh("bad")
        with pytest.raises(ValueError):
            store_keyed(spark.createDataFrame(rows, "k int, v int"), name, ["k"], 2)
        assert not spark.catalog.tableExists(name)
    empty = store_keyed(spark.createDataFrame([], "k int, v int"), fresh("none"), ["k"], 2)
    full = store_keyed(spark.createDataFrame([(1, 5)], "k int, w int"), fresh("one"), ["k"], 2)
    assert [tuple(r) for r in merge_stored(spark, [empty, full], ["k"], store_spine(spark, [empty, full], fresh("s"), ["k"], 2)).collect()] == [(1, None, 5)]
    with pytest.raises(ValueError):
        merge_stored(spark, [full, full], ["k"], full)
    # A table is replaced only when asked.
    with pytest.raises(Exception, match="already exists"):
        store_keyed(spark.createDataFrame([(1, 5)], "k int, w int"), full, ["k"], 2)


SCHEMA = T.StructType([T.StructField("State", T.StringType()), T.StructField("Pov.All", T.DoubleType()), T.StructField("n", T.IntegerType())])


def test_bad_records_keep_their_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿State,Pov.All,n\n"St. Francis, AR",30.5,1\nFL,n/a,2\n\nMD,9.0,x7\nTX,1.5\nVA,,\nWV,bad,bad\n"A ""B""",2,3,4\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("State,Pov.All,n\r\nKY,1e3,5\r\nOH,2,2.5\r\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("")
    rows, rejects = read_csv_checked(spark, str(tmp_path), SCHEMA)
    assert rows.columns == ["State", "Pov_All", "n"] and rows.schema["Pov_All"].metadata["source_name"] == "Pov.All"
    assert sorted(map(tuple, rows.collect())) == [("KY", 1000.0, 5), ("St. Francis, AR", 30.5, 1), ("VA", None, None)]
    got = sorted((r.file, r.line, r.reason, r.record) for r in rejects.collect())
    assert got == [
        ("a.csv", 3, "does not fit: Pov.All", "FL,n/a,2"), ("a.csv", 5, "does not fit: n", "MD,9.0,x7"), ("a.csv", 6, "not 3 fields", "TX,1.5"),
        ("a.csv", 8, "does not fit: Pov.All, n", "WV,bad,bad"), ("a.csv", 9, "not 3 fields", '"A ""B""",2,3,4'), ("b.csv", 3, "does not fit: n", "OH,2,2.5"),
    ]


def test_line_numbers_across_blocks_of_a_file(spark, tmp_path):
    """Files cut into many blocks, read by many tasks: every record keeps its line."""
    for name in ("x", "y"):
        lines = [f"s{i},{i}.5,{'bad' if i % 17 == 0 else i}" for i in range(4000)]
        (tmp_path / f"{name}.csv").write_text("\n".join(["State,Pov.All,n", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows, rejects = read_csv_checked(spark, str(tmp_path), SCHEMA)
        assert rows.rdd.getNumPartitions() > 5
        assert rows.count() == 2 * (4000 - 236)
        got = {(r.file, r.line, r.record) for r in rejects.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(f"{name}.csv", i + 2, f"s{i},{i}.5,bad") for name in "xy" for i in range(0, 4000, 17)}


def test_scored_schema_names_61_columns():
    assert len(SCORED_SCHEMA.fields) == 61 and len(set(SCORED_SCHEMA.names)) == 61
    assert SCORED_SCHEMA.names[0] == "F1" and SCORED_SCHEMA.names[60] == "Type.2015.Recreation.NO" and SCORED_SCHEMA["Inf."].dataType == T.DoubleType()


def test_committed_export(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit('a "q", '), "id")).alias("t"), (F.col("id") / 3).alias("p")).repartition(6)
    schema = T.StructType([T.StructField("F1", T.LongType()), *df.schema.fields])
    with pytest.raises(FileNotFoundError):
        read_export(spark, path, schema)
    assert export_committed(df, path, ["k"]) == 1
    want = sorted((r.k + 1, r.k, r.t, r.p) for r in df.collect())
    assert sorted(map(tuple, read_export(spark, path, schema).collect())) == want
    files = [r for r in manifest(spark, path).collect() if r.file]
    assert sum(r.rows for r in files) == 500 and all(r.last - r.first + 1 == r.rows for r in files if r.rows)
    # Files are ranges: a few rows open few files.
    some = read_export(spark, path, schema, first=11, last=13)
    assert [r.F1 for r in some.orderBy("F1").collect()] == [11, 12, 13]
    assert len(some.inputFiles()) <= len(files)
    # A write that breaks off leaves files that nobody sees.
    broken = df.withColumn("p", F.when(F.col("k") == 250, F.raise_error(F.lit("disk full")).cast("double")).otherwise(F.col("p")))
    with pytest.raises(Exception, match="disk full"):
        export_committed(broken, path, ["k"])
    df.limit(3).select(F.lit(99).cast("long").alias("F1"), "*").write.csv(f"{path}/data-half")
    assert sorted(map(tuple, read_export(spark, path, schema).collect())) == want
    # The next version takes over; the first can still be read.
    assert export_committed(df.filter("k < 3"), path, ["k"], "parquet") == 2
    assert [r.k for r in read_export(spark, path, schema).orderBy("F1").collect()] == [0, 1, 2]
    assert read_export(spark, path, schema, version=1).count() == 500
    assert export_committed(df.limit(0), path, ["k"]) == 3 and read_export(spark, path, schema).collect() == []


def test_export_deals_out_anew_without_a_broadcast(spark, tmp_path, monkeypatch):
    from strata.operators import window

    monkeypatch.setattr(window, "MAX_BROADCAST_BYTES", 0)
    monkeypatch.setattr(window.bounded_broadcast, "__defaults__", (0,))
    path = str(tmp_path / "out")
    df = spark.range(300).select(F.col("id").alias("k"))
    export_committed(df.repartition(5), path, ["k"], "parquet")
    schema = T.StructType([T.StructField("F1", T.LongType()), T.StructField("k", T.LongType())])
    assert sorted((r.F1, r.k) for r in read_export(spark, path, schema).collect()) == [(i + 1, i) for i in range(300)]
