import os
import tempfile

from pyspark.sql import functions as F

from strata.operators import categorical as C
from strata.operators import evaluate as EV
from strata.operators import ml as ML
from strata.sources import export_scored, read_csv, read_label_list


def _planted(spark, n=3000):
    # y depends on x1 (plus a key-hash "noise" flip); x2 and the category are noise.
    rows = []
    for i in range(n):
        x1 = (i * 7919) % 1000 / 10.0
        x2 = (i * 104729) % 997 / 10.0
        cat = "ab"[(i * 31) % 2]
        noise = (i * 2654435761) % 100 < 10
        y = int((x1 > 50) != noise)
        rows.append((i, x1, x2, cat, y))
    return spark.createDataFrame(rows, "k long, x1 double, x2 double, cat string, y int")


SPEC = ML.FeatureSpec(label="y", numeric=["x1", "x2"], categorical=["cat"])


def test_hash_split_is_partition_independent(spark):
    df = _planted(spark)
    one = sorted(r.k for r in ML.hash_split(df.repartition(1), ["k"]).filter("part = 'test'").collect())
    eight = sorted(r.k for r in ML.hash_split(df.repartition(8), ["k"]).filter("part = 'test'").collect())
    assert one == eight
    assert 0.2 < len(one) / 3000 < 0.3


def test_models_score_planted_signal(spark):
    df = ML.hash_split(_planted(spark), ["k"])
    train = df.filter("part = 'training'")
    test = df.filter("part = 'test'")
    models = ML.fit_all(train, SPEC)
    scored = ML.score_all(models, test, SPEC, ["k"])
    sums = scored.select((F.col("probability_0") + F.col("probability_1")).alias("s")).agg(
        F.min("s"), F.max("s")
    ).first()
    assert abs(sums[0] - 1) < 1e-9 and abs(sums[1] - 1) < 1e-9
    auc = {r.model: r.auc for r in EV.auc_hard(scored, "y", "prediction").collect()}
    assert set(auc) == {"Logistic", "Decision Tree", "Random Forest", "Gradient Boosted Trees"}
    assert all(v > 80 for v in auc.values())


def test_score_all_in_one_pass_equals_single_models(spark):
    df = _planted(spark, 600)
    models = ML.fit_all(df, SPEC, ["Logistic", "Decision Tree"])
    together = ML.score_all(models, df, SPEC, ["k"])
    alone = ML.score(models["Logistic"], df, SPEC, ["k"], "Logistic").unionByName(
        ML.score(models["Decision Tree"], df, SPEC, ["k"], "Decision Tree")
    )
    assert together.columns == alone.columns
    assert sorted(map(tuple, together.collect())) == sorted(map(tuple, alone.collect()))
    # Models of different fits have encodings of their own.
    other = {"a": models["Logistic"], "b": ML.fit(ML.estimators()["Logistic"], df, SPEC)}
    assert ML.score_all(other, df, SPEC, ["k"]).count() == 1200


def test_model_label_can_be_learned(spark):
    from strata.plans.catalogue import QUERIES

    rows = QUERIES["permutation_importance"](spark, "/root/testdata/sf0.001").collect()
    drop = {r.feature: r.importance for r in rows}
    assert max(drop, key=drop.get) == "l_extendedprice" and drop["l_extendedprice"] > 0.1


def test_importance_ranks_planted_feature_first(spark):
    df = _planted(spark)
    tree = ML.fit(ML.estimators()["Decision Tree"], df, SPEC)
    ranked = ML.feature_importance(tree, df, SPEC)
    assert ranked[0][0] == "x1"
    assert {name for name, _ in ranked} == {"x1", "x2", "cat"}
    assert abs(sum(v for _, v in ranked) - 1.0) < 1e-9
    assert ML.select_features(ranked, 2)[0] == "x1"


def test_permutation_importance_ranks_planted_feature_first(spark):
    df = ML.hash_split(_planted(spark), ["k"])
    train = df.filter("part = 'training'")
    test = df.filter("part = 'test'").drop("part")
    model = ML.fit(ML.estimators()["Random Forest"], train, SPEC)
    imp = {r.feature: r.importance for r in ML.permutation_importance(model, test, SPEC, ["k"]).collect()}
    assert max(imp, key=imp.get) == "x1"
    assert imp["x1"] > 0.2


def test_unseen_category_is_kept(spark):
    df = _planted(spark)
    model = ML.fit(ML.estimators()["Logistic"], df, SPEC)
    late = df.limit(5).withColumn("cat", F.lit("zzz"))
    assert ML.score(model, late, SPEC, ["k"]).count() == 5


def test_level_codes_sorted_one_based(spark):
    df = spark.createDataFrame([("1",), ("0",), (None,), ("1",)], "METRO string")
    got = [r.level for r in C.level_codes(df, "METRO").collect()]
    assert got == [2, 1, None, 2]
    labels = [r[0] for r in C.level_codes(df, "METRO").select(C.level_labels("level", ["Rural", "Urban"])).collect()]
    assert labels == ["Urban", "Rural", None, "Urban"]


def test_csv_bom_dotted_names_and_label_list(spark):
    d = tempfile.mkdtemp(prefix="strata-csv-")
    path = os.path.join(d, "list.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("﻿State,County,Urban,Desert,Pov.All\n")
        fh.write("AR,St. Francis,0,1,30.5\nFL,Miami-Dade,1,1,20.1\nMD,Prince George's,1,1,9.0\nAR,St. Francis,0,1,30.5\n")
    df = read_csv(spark, path, schema="State string, County string, Urban int, Desert int, `Pov.All` double")
    assert df.columns == ["State", "County", "Urban", "Desert", "Pov_All"]
    assert df.schema["Pov_All"].metadata["source_name"] == "Pov.All"
    inferred = read_csv(spark, path)
    assert inferred.columns[0] == "State"
    lst = read_label_list(spark, path, ["State", "County"], "Desert", schema="State string, County string, Urban int, Desert int, `Pov.All` double")
    assert lst.count() == 3


def test_export_scored_writes_index(spark):
    d = tempfile.mkdtemp(prefix="strata-out-")
    df = spark.createDataFrame([(3, 0.2), (1, 0.9), (2, 0.5)], "k int, p double")
    out = export_scored(df, os.path.join(d, "preds"), ["k"])
    assert [(r.F1, r.k) for r in out.orderBy("F1").collect()] == [(1, 1), (2, 2), (3, 3)]
    back = spark.read.option("header", True).csv(os.path.join(d, "preds"))
    assert back.count() == 3 and back.columns[0] == "F1"


def test_error_curve_last_point_equals_forest_error(spark):
    df = ML.hash_split(_planted(spark, 1500), ["k"])
    train = df.filter("part = 'training'")
    test = df.filter("part = 'test'")
    curve = {r.trees: r.error for r in ML.forest_error_curve(train, test, SPEC, grid=(1, 3, 7)).collect()}
    assert set(curve) == {1, 3, 7}
    from pyspark.ml.classification import RandomForestClassifier

    forest = ML.fit(RandomForestClassifier(numTrees=7, seed=ML.SEED, featuresCol="features", labelCol="label"), train, SPEC)
    scored = forest.transform(ML.with_label(test, SPEC))
    err = scored.agg(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
    assert abs(curve[7] - err) < 1e-12


def test_error_curve_scores_rows_alike_once(spark, monkeypatch):
    """Hold-out rows that no cut tells apart go through the trees once; the errors are those of all rows."""
    from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassifier

    df = ML.hash_split(_planted(spark, 1500), ["k"])
    train = df.filter("part = 'training'").drop("part")
    once = df.filter("part = 'test'").drop("part")
    odd = once.select("k", F.when(F.col("k") % 2 == 0, F.lit(float("nan"))).alias("x1"), "x2", F.when(F.col("k") % 3 > 0, "zzz").alias("cat"), "y")
    blank = once.select("k", "x1", "x2", "cat", F.lit(None).cast("int").alias("y"))
    # Close to each row stand others: on the same side of every cut, but not equal.
    near = F.col("x2") + F.col("id") * 1e-9
    test = once.union(odd).union(blank).filter("k % 5 = 0").crossJoin(spark.range(9)).withColumn("x2", near).drop("id").localCheckpoint()

    grid = (1, 3, 7)
    forest = ML.fit(RandomForestClassifier(numTrees=7, seed=ML.SEED, featuresCol="features", labelCol="label"), train, SPEC)
    rows = ML.PipelineModel(stages=forest.stages[:-1]).transform(ML.with_label(test, SPEC)).filter("label is not null").collect()
    wrong = dict.fromkeys(grid, 0)
    for r in rows:
        votes = [float(t.predictProbability(r.features)[1]) for t in forest.stages[-1].trees]
        for k in grid:
            wrong[k] += float(sum(votes[:k], 0.0) > k / 2) != r.label

    scored = []
    transform = DecisionTreeClassificationModel.transform
    monkeypatch.setattr(DecisionTreeClassificationModel, "transform", lambda tree, rows: scored.append(rows) or transform(tree, rows))
    curve = {r.trees: r.error for r in ML.forest_error_curve(train, test, SPEC, grid=grid).collect()}
    assert all(abs(curve[k] - wrong[k] / len(rows)) < 1e-12 for k in grid) and wrong[7] > 0
    assert scored[0].count() <= len(rows) / 9
    assert [r.error for r in ML.forest_error_curve(train, test.limit(0), SPEC, grid=grid).collect()] == [None] * 3


def test_register_view_and_parquet_copy(spark):
    from strata.sources import register_view, to_parquet_once

    df = spark.createDataFrame([(1, "AL"), (2, "Total")], "k int, State string")
    register_view(df, "areas_view")
    assert spark.sql("SELECT count(*) AS n FROM areas_view WHERE length(State) <= 2").first().n == 1
    out = to_parquet_once(df, os.path.join(tempfile.mkdtemp(prefix="strata-pq-"), "areas"))
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == [1, 2]


def test_label_unrelated_to_features_gives_auc_near_half(spark):
    # Label from a key hash only: no feature carries signal.
    df = _planted(spark, 4000).withColumn("y", (F.pmod(ML.key_hash(["k"]), F.lit(2)) == 1).cast("int"))
    split = ML.hash_split(df, ["k"])
    model = ML.fit(ML.estimators()["Logistic"], split.filter("part = 'training'"), SPEC)
    scored = ML.score(model, split.filter("part = 'test'"), SPEC, ["k"], "Logistic")
    auc = EV.auc_ranked(scored, "y", "probability_1").collect()[0].auc
    assert 40 < auc < 60
