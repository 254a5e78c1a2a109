"""Spark ML classification workflow (O-61 … O-72, O-77).

* features: ``StringIndexer`` (labels in value order, unseen -> extra index)
  -> ``OneHotEncoder`` -> ``VectorAssembler``, on normalised column names;
* split: a hash of the row key, so the split does not change with the
  number or order of partitions (``randomSplit`` does);
* four estimators with the Spark defaults the reference relied on; trees cut
  features that are binned first at exact quantiles, so their candidates are the
  same for any partitioning, and the forest's bags follow from the rows
  (``operators.forest``); fits of one table run side by side;
* scoring to one long table ``(model, keys…, label, prediction, probability_1)``
  that every evaluator consumes in one grouped job;
* importances: impurity importances mapped back to source columns, and
  hold-out permutation importance computed for all features in one job.

The assembled training table is checkpointed to the session's checkpoint
folder before the fits: every estimator makes many passes over it, and a
lost executor then re-reads the checkpoint instead of recomputing the
scan, join and encoding.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.session import checkpoint_dir

SEED = 123
_MOD = 2147483647  # 2^31 - 1
_MUL = 1000003
_MIX = 1103515245
KEY_HASHES = _MOD


def key_hash(cols: Sequence[str], df: DataFrame | None = None):
    """Integer hash of a row key by Horner's rule modulo 2^31-1.

    Only integer arithmetic (float keys enter as cents), so any engine
    computes the same value; stays far below 2^63 at every step. With ``df``
    the column types decide: text enters as the first 32 bits of its md5, a
    null as -1.
    """
    types = dict(df.dtypes) if df is not None else {}
    h = F.lit(0).cast("long")
    for c in cols:
        v = F.col(c)
        kind = types.get(c, "double" if c.endswith("price") else "bigint")
        if kind == "string":
            v = F.conv(F.substring(F.md5(v.cast("binary")), 1, 8), 16, 10).cast("long")
        else:
            v = F.round(v * 100).cast("long") if kind in ("double", "float") or kind.startswith("decimal") else v.cast("long")
        v = F.coalesce(v, F.lit(-1).cast("long"))
        h = (h * F.lit(_MUL) + F.pmod(v, F.lit(_MOD))) % F.lit(_MOD)
    # Final multiplicative mix: without it a single small key hashes to itself.
    return ((h + F.lit(1)) * F.lit(_MIX)) % F.lit(_MOD)


def hash_split(df: DataFrame, key_cols: Sequence[str], test_fraction: float = 0.25, out: str = "part") -> DataFrame:
    """Deterministic 75/25 split (O-62): ``test`` where the key hash falls in the first
    ``test_fraction`` of 10,000 buckets."""
    bucket = key_hash(key_cols, df) % F.lit(10000)
    return df.withColumn(out, F.when(bucket < F.lit(int(test_fraction * 10000)), "test").otherwise("training"))


@dataclass
class FeatureSpec:
    label: str
    numeric: list[str]
    categorical: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def only(self, keep: Sequence[str]) -> "FeatureSpec":
        keep = set(keep)
        return FeatureSpec(self.label, [c for c in self.numeric if c in keep], [c for c in self.categorical if c in keep])


# Bins of a numeric feature that trees choose their cuts from.
BINS = 32


def bin_sql(column: str, cuts: Sequence[float]) -> str:
    """SQL for the number of cut points that a value reaches, found by halving.

    A missing value has a bin of its own above all others.
    """

    def search(lo: int, hi: int) -> str:
        if lo == hi:
            return f"{lo}D"
        mid = (lo + hi) // 2
        return f"CASE WHEN x < {float(cuts[mid])!r}D THEN {search(lo, mid)} ELSE {search(mid + 1, hi)} END"

    x = f"CAST(`{column}` AS DOUBLE)"
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {len(cuts) + 1}D ELSE {search(0, len(cuts)).replace('x <', x + ' <')} END"


def feature_stages(spec: FeatureSpec, cuts: dict[str, list[float]] | None = None) -> list:
    """Formula ``label ~ features`` as pipeline stages (O-61).

    ``features`` holds the values and the one-hot levels. With ``cuts``,
    ``binned`` holds the bins of the numeric columns beside the same levels.
    """
    stages = []
    encoded = []
    if spec.categorical:
        idx = [f"{c}__idx" for c in spec.categorical]
        encoded = [f"{c}__ohe" for c in spec.categorical]
        stages.append(
            StringIndexer(
                inputCols=spec.categorical, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"
            )
        )
        stages.append(OneHotEncoder(inputCols=idx, outputCols=encoded, handleInvalid="keep", dropLast=True))
    if cuts is not None:
        bins = ", ".join(f"{bin_sql(c, cuts[c])} AS `{c}__bin`" for c in spec.numeric)
        stages.append(SQLTransformer(statement=f"SELECT *{', ' + bins if bins else ''} FROM __THIS__"))
        stages.append(VectorAssembler(inputCols=[*(f"{c}__bin" for c in spec.numeric), *encoded], outputCol="binned", handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[*spec.numeric, *encoded], outputCol="features", handleInvalid="keep"))
    return stages


@dataclass
class BaggedForest:
    """Settings of a forest whose bags follow from the rows (``operators.forest``)."""

    trees: int = 20
    depth: int = 5
    seed: int = SEED


def estimators(seed: int = SEED) -> dict:
    """The four classifiers (O-63 … O-66) with the defaults the reference used.

    The reference's "probit" is a binomial logit; its extra ``maxit`` argument
    is ignored by the R wrapper, so Spark's default of 100 iterations applies.
    """
    values, bins = ({"featuresCol": c, "labelCol": "label"} for c in ("features", "binned"))
    return {
        "Logistic": LogisticRegression(family="binomial", maxIter=100, regParam=0.0, **values),
        # One bin more for missing values.
        "Decision Tree": DecisionTreeClassifier(maxDepth=5, maxBins=BINS + 1, seed=seed, **bins),
        "Random Forest": BaggedForest(20, 5, seed),
        "Gradient Boosted Trees": GBTClassifier(maxIter=20, stepSize=0.1, maxBins=BINS + 1, seed=seed, **bins),
    }


def with_label(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    return df.withColumn("label", F.col(spec.label).cast("double"))


def materialize(df: DataFrame, keys: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Deal out by ``keys`` (default: all columns) and cut the lineage of a frame reused by many fits.

    The number of partitions follows from the bytes (AQE) unless it is given;
    no fit depends on it. The frame is written to the reliable checkpoint
    folder, so a lost executor re-reads files instead of re-running the scan
    and filters. With ``partitions`` rows land in the same partition and order
    whatever the input's partitioning.
    """
    checkpoint_dir(df.sparkSession)
    by = [F.col(c) for c in (keys or df.columns)]
    if partitions is None:
        return df.repartition(*by).checkpoint(eager=True)
    return df.repartition(partitions, *by).sortWithinPartitions(*by).checkpoint(eager=True)


# Fits of one table that run at a time.
MAX_FITS = 4


def side_by_side(tasks: dict[str, Callable], limit: int = MAX_FITS) -> dict:
    """Run the tasks in ``limit`` threads, each in a scheduler pool of its name.

    A fit is a row of small jobs with the driver's work between them; others use
    the executors meanwhile. Under the FAIR scheduler the pools share them evenly.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()

    def named(name: str) -> Callable:
        def run():
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
            return tasks[name]()

        return inheritable_thread_target(spark)(run)

    if len(tasks) < 2:
        return {name: task() for name, task in tasks.items()}
    with ThreadPoolExecutor(max_workers=min(limit, len(tasks))) as pool:
        started = {name: pool.submit(named(name)) for name in tasks}
        return {name: f.result() for name, f in started.items()}


# Partitions of the binned rows that trees are grown on; a fit may depend on it in the last digits.
CELL_PARTITIONS = 16


def binned_cells(labelled: DataFrame, encoding: PipelineModel, spec: FeatureSpec, cuts: dict[str, list[float]]) -> DataFrame:
    """(binned, label, weight): a row per combination of bins, levels and label, weighing as many rows as it stands for.

    Trees tell rows apart by nothing else, so they grow the same; there are at
    most as many combinations as bins and levels allow, however many rows.
    """
    bins = [F.expr(bin_sql(c, cuts[c])).alias(f"{c}__bin") for c in spec.numeric]
    counted = labelled.groupBy(*bins, *spec.categorical, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    # The order of the rows is that of the sums in the fits.
    cells = materialize(counted, partitions=CELL_PARTITIONS)
    for stage in encoding.stages[:-1]:
        if not isinstance(stage, SQLTransformer):
            cells = stage.transform(cells)
    return cells.select("binned", "label", "weight").checkpoint(eager=True)


def _fit_with_features(estimators_by_name: dict, train: DataFrame, spec: FeatureSpec) -> dict:
    """Fit the encoding once, checkpoint the assembled vectors for the fits, and
    return one ``PipelineModel`` per estimator."""
    from strata.operators import forest as FO

    labelled = with_label(train, spec)
    forests = {n: e for n, e in estimators_by_name.items() if isinstance(e, BaggedForest)}
    others = {n: e for n, e in estimators_by_name.items() if n not in forests}
    uses = {e.getFeaturesCol() for e in others.values()}
    cuts = FO.quantile_cuts(train, spec.numeric, BINS) if forests or "binned" in uses else None
    encoding = Pipeline(stages=feature_stages(spec, cuts)).fit(labelled)
    tasks: dict[str, Callable] = {}
    values = {n: e for n, e in others.items() if e.getFeaturesCol() == "features"}
    if values:
        checkpoint_dir(train.sparkSession)
        assembled = encoding.transform(labelled).select("features", "label").checkpoint(eager=True)
        tasks |= {name: (lambda est=est: est.fit(assembled)) for name, est in values.items()}
    if others.keys() - values.keys():
        cells = binned_cells(labelled, encoding, spec, cuts)
        # Spark chooses candidate cuts from maxBins ** 2 rows; with this many, no bin is overlooked.
        bins = max(BINS + 1, math.isqrt(cells.count()) + 1)
        for name in others.keys() - values.keys():
            est = others[name]
            tree = est.copy({est.maxBins: max(bins, est.getMaxBins()), est.weightCol: "weight"})
            tasks[name] = lambda tree=tree: tree.fit(cells)
    if forests:
        # A row's bags follow from all its values.
        binned = FO.bin_features(train, spec, sorted(train.columns), BINS, cuts)
        tasks |= {name: (lambda e=e: FO.forest_model(binned, spec, FO.grow(binned, e.trees, e.depth, seed=e.seed))) for name, e in forests.items()}
    fitted = side_by_side(tasks)
    return {name: PipelineModel(stages=[*encoding.stages, fitted[name]]) for name in estimators_by_name}


def fit(estimator, train: DataFrame, spec: FeatureSpec) -> PipelineModel:
    return _fit_with_features({"m": estimator}, train, spec)["m"]


def fit_all(train: DataFrame, spec: FeatureSpec, names: Sequence[str] | None = None, seed: int = SEED) -> dict:
    est = estimators(seed)
    return _fit_with_features({n: est[n] for n in (names or list(est))}, train, spec)


def score(model: PipelineModel, df: DataFrame, spec: FeatureSpec, keys: Sequence[str], name: str = "model") -> DataFrame:
    """``ml_predict`` (O-67): keys, label, hard prediction, probability_0/1.

    Labels are indexed in value order, so probability_1 is always P(label = 1).
    """
    out = model.transform(with_label(df, spec))
    prob = vector_to_array("probability")
    return out.select(
        F.lit(name).alias("model"),
        *keys,
        F.col(spec.label).cast("int").alias(spec.label),
        F.col("prediction"),
        prob[0].alias("probability_0"),
        prob[1].alias("probability_1"),
    )


def score_all(models: dict, df: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """Score many named models into one long table (O-68, O-88).

    Models of one ``fit_all`` share their encoding: the rows are read and
    encoded once, every model adds its own columns, and each row emits one
    output row per model. Other models are scored one after the other.
    """
    encodings = [m.stages[:-1] for m in models.values()]
    if any(len(e) != len(encodings[0]) or any(a is not b for a, b in zip(e, encodings[0])) for e in encodings):
        frames = [score(m, df, spec, keys, name) for name, m in models.items()]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out
    wide = PipelineModel(stages=encodings[0]).transform(with_label(df, spec))
    rows = []
    for i, (name, model) in enumerate(models.items()):
        last = model.stages[-1].copy()
        last.setProbabilityCol(f"_prob{i}").setRawPredictionCol(f"_raw{i}").setPredictionCol(f"_hard{i}")
        wide = last.transform(wide)
        prob = vector_to_array(f"_prob{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("model"),
                F.col(f"_hard{i}").alias("prediction"),
                prob[0].alias("probability_0"),
                prob[1].alias("probability_1"),
            )
        )
    label = F.col(spec.label).cast("int").alias(spec.label)
    out = wide.select(*keys, label, F.inline(F.array(*rows)))
    return out.select("model", *keys, spec.label, "prediction", "probability_0", "probability_1")


def feature_importance(model: PipelineModel, sample: DataFrame, spec: FeatureSpec) -> list[tuple[str, float]]:
    """Impurity importances of a tree model mapped back to source columns (O-69, O-21).

    Encoded columns (``col__ohe_level``) are summed into their source column
    through the assembler's ``ml_attr`` metadata, so a selected feature is
    always a real input column. Sorted descending.
    """
    tree = model.stages[-1]
    totals: dict[str, float] = {c: 0.0 for c in spec.columns}
    if hasattr(tree, "gains"):
        for c, gain in tree.gains().items():
            totals[c] += gain
        return sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))
    vec = tree.featureImportances
    # Reading the schema runs no job: the assembler's metadata is planned, not computed.
    meta = model.transform(with_label(sample, spec)).schema[tree.getFeaturesCol()].metadata
    attrs = []
    for group in meta.get("ml_attr", {}).get("attrs", {}).values():
        attrs.extend(group)
    names = {a["idx"]: a["name"] for a in attrs}
    for i in range(vec.size):
        totals[source_of(names[i], spec)] += float(vec[i])
    return sorted(totals.items(), key=lambda kv: (-kv[1], kv[0]))


def source_of(encoded: str, spec: FeatureSpec) -> str:
    """The column that an encoded column comes from; of nested names the longest."""
    for c in sorted(spec.columns, key=len, reverse=True):
        if encoded in (c, f"{c}__bin") or encoded.startswith(f"{c}__ohe"):
            return c
    raise ValueError(f"{encoded} comes from no column of the formula")


def importance_frame(spark, ranked: list[tuple[str, float]]) -> DataFrame:
    """Importance list (one row per input column) with rank and cumulative share (O-49)."""
    rows = []
    cum = 0.0
    for i, (name, imp) in enumerate(ranked, start=1):
        cum += imp
        rows.append((i, name, float(imp), float(cum)))
    return spark.createDataFrame(rows, "rank int, feature string, importance double, cumulative double")


def select_features(ranked: list[tuple[str, float]], k: int) -> list[str]:
    """Top-k source columns, de-duplicated (O-72)."""
    out: list[str] = []
    for name, _ in ranked:
        if name not in out:
            out.append(name)
        if len(out) == k:
            break
    return out


def permuted_copies(df: DataFrame, spec: FeatureSpec, keys: Sequence[str], buckets: int = 256) -> DataFrame:
    """One permuted copy of ``df`` per feature, stacked with a ``feature`` column (O-70).

    Each feature's values are rotated by one position in key-hash order
    inside ``buckets`` hash buckets (a cyclic ``lead``),
    which breaks the link between feature and label while keeping the
    marginal distribution. All features are rotated in one window pass (one
    shuffle on the bucket; buckets bound each window group), then each row
    emits its per-feature copies through one ``inline``. No row is dropped.
    """
    base = df.withColumn("_h", key_hash(keys, df)).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)))
    w = Window.partitionBy("_b").orderBy("_h", *keys)
    w_all = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    feats = spec.columns
    rotated = base.select(
        *df.columns,
        *[F.coalesce(F.lead(f, 1).over(w), F.first(f).over(w_all)).alias(f"_rot_{f}") for f in feats],
    )
    copies = [
        F.struct(
            F.lit(f).alias("feature"),
            *[(F.col(f"_rot_{c}") if c == f else F.col(c)).alias(c) for c in df.columns],
        )
        for f in feats
    ]
    return rotated.select(F.inline(F.array(*copies)))


def permutation_importance(
    model: PipelineModel, test: DataFrame, spec: FeatureSpec, keys: Sequence[str]
) -> DataFrame:
    """Mean decrease in hold-out accuracy when one feature is permuted (O-70).

    All features are rescored in one transform over the stacked copies, then
    one grouped aggregate gives accuracy per feature.
    """
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    base = model.transform(with_label(test, spec)).agg(hit.alias("acc")).first()["acc"]
    permuted = model.transform(with_label(permuted_copies(test, spec, keys), spec))
    per = permuted.groupBy("feature").agg(hit.alias("acc_perm"))
    return per.select("feature", (F.lit(base) - F.col("acc_perm")).alias("importance"))


def forest_cuts(forest, spec: FeatureSpec) -> dict[str, list[float]]:
    """The values that the trees of one of Spark's forests cut each numeric column at; ``x <= cut`` goes left."""
    found: dict[str, set[float]] = {c: set() for c in spec.numeric}
    for feature, test in re.findall(r"If \(feature (\d+) ([^)]*)\)", forest.toDebugString):
        if int(feature) < len(spec.numeric):
            if not test.startswith("<= "):
                raise ValueError(f"{spec.numeric[int(feature)]} is not cut like a number: {test}")
            found[spec.numeric[int(feature)]].add(float(test[3:]))
    return {c: sorted(v) for c, v in found.items()}


def alike_rows(df: DataFrame, spec: FeatureSpec, cuts: dict[str, list[float]]) -> DataFrame:
    """(numeric and categorical columns, label, _rows): one row for all that lie between the same cuts, with the same levels and label.

    Trees with these cuts send all ``_rows`` of them to the leaf of that one. There are at
    most as many as cuts, levels and labels combine. Rows without a label are left out.
    """
    x = {c: F.col(c).cast("double") for c in spec.numeric}
    above = [sum(((x[c] > F.lit(v)).cast("int") for v in cuts[c]), F.when(x[c].isNotNull(), 0)).alias(f"{c}__above") for c in spec.numeric]
    label = F.col(spec.label).cast("double").alias("label")
    alike = df.filter(F.col(spec.label).isNotNull()).groupBy(*above, *spec.categorical, label)
    one = [F.min(x[c]).alias(c) for c in spec.numeric]
    return alike.agg(*one, F.count(F.lit(1)).alias("_rows")).select(*spec.columns, "label", "_rows")


def forest_error_curve(
    train: DataFrame,
    test: DataFrame,
    spec: FeatureSpec,
    grid: Sequence[int] = (1, 5, 10, 20, 50, 100),
    seed: int = SEED,
) -> DataFrame:
    """Hold-out error of the first k trees of one forest, for k in ``grid`` (O-71).

    The reference plots the error of one 100-tree forest as trees are added
    (out-of-bag; Spark does not expose OOB, so the hold-out rows are used).
    One forest of ``max(grid)`` trees is fitted; hold-out rows that no tree can
    tell apart are scored once and count as many as they are. Each tree scores
    them in the same pass, and a prefix of k trees votes the way the
    forest does (sum of per-tree class probabilities, ties to class 0). All
    grid points come from one aggregate.
    """
    ntree = max(grid)
    model = fit(RandomForestClassifier(numTrees=ntree, seed=seed, featuresCol="features", labelCol="label"), train, spec)
    encoding = PipelineModel(stages=model.stages[:-1])
    forest = model.stages[-1]
    checkpoint_dir(test.sparkSession)
    df = encoding.transform(alike_rows(test, spec, forest_cuts(forest, spec))).select("features", "label", "_rows").checkpoint(eager=True)
    trees = forest.trees
    # Each tree adds only its probability column (raw score and prediction
    # outputs switched off), and one final projection reads them all: the plan
    # grows by one node per tree instead of three, which keeps planning cheap.
    for i, tree in enumerate(trees):
        tree.setProbabilityCol(f"_prob{i}").setRawPredictionCol("").setPredictionCol("")
        df = tree.transform(df)
    df = df.select("label", "_rows", *[vector_to_array(f"_prob{i}")[1].alias(f"_q{i}") for i in range(len(trees))])
    aggs = []
    for k in grid:
        votes = sum((F.col(f"_q{i}") for i in range(k)), F.lit(0.0))
        wrong = (votes > F.lit(k / 2.0)).cast("double") != F.col("label")
        aggs.append(F.try_divide(F.sum(F.when(wrong, F.col("_rows")).otherwise(0)), F.sum("_rows")).alias(f"e{k}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(k).alias("trees"), F.col(f"e{k}").alias("error")) for k in grid]
    return wide.select(F.inline(F.array(*rows)))
