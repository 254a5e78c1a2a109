"""Bagged trees against plain loops, and independence of the partitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import forest as FO
from strata.operators.ml import FeatureSpec, key_hash

SPEC = FeatureSpec("y", ["a", "b"], ["c"])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        a, b, c = float(rng.normal()), float(rng.integers(0, 9)), str(rng.choice(["u", "v", "w"]))
        y = int(a + (b > 4) + (c == "v") + rng.normal() > 1)
        rows.append((i, a if i % 50 else None, b if i % 70 else math.nan, c if i % 60 else None, y if i % 90 else None))
    return spark.createDataFrame(rows, "k long, a double, b double, c string, y int")


@pytest.fixture(scope="module")
def binned(table):
    return FO.bin_features(table, SPEC, ["k"], bins=8)


def matrix(binned):
    rows = binned.rows.collect()
    return np.array([r.h for r in rows]), np.array([r.y for r in rows]), np.array([list(r)[2:] for r in rows])


def plain_tree(t, h, y, x, width, depth, tried, bagged=True):
    """Node by node, every cut tried."""
    w = FO.bag_weights(h, t) if bagged else np.ones(len(h), dtype=int)
    out = {}

    def split(node, rows, level):
        n, s = int(w[rows].sum()), int((w * y)[rows].sum())
        out[node] = [-1, 0, s / n]
        if level == depth or not 0 < s < n and node > 1:
            return
        best = (0.0,)
        for f in FO.candidates(t, node, x.shape[1], tried):
            for b in range(width):
                left = rows[x[rows, f] <= b]
                nl, sl = int(w[left].sum()), int((w * y)[left].sum())
                if 0 < nl < n:
                    gain = 2 * (sl * sl / nl + (s - sl) ** 2 / (n - nl) - s * s / n)
                    if gain > 1e-9 * n and (gain, -f, -b) > best:
                        best = (gain, -f, -b)
        if len(best) > 1:
            f, b = -best[1], -best[2]
            out[node][:2] = [f, b]
            split(2 * node, rows[x[rows, f] <= b], level + 1)
            split(2 * node + 1, rows[x[rows, f] > b], level + 1)

    split(1, np.flatnonzero(w > 0), 0)
    return out


def same_trees(one, other):
    return all((a.feature == b.feature).all() and (a.cut == b.cut).all() and (a.value == b.value).all() for a, b in zip(one, other, strict=True))


def test_bag_weights_are_poisson_and_equal_the_expression(spark):
    h = np.random.default_rng(0).integers(0, FO.MODULUS, 200_000)
    for t in (0, 57):
        w = FO.bag_weights(h, t)
        assert abs((w == 0).mean() - math.exp(-1)) < 0.005 and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    both = np.mean((FO.bag_weights(h, 3) == 0) & (FO.bag_weights(h, 4) == 0))
    assert abs(both - math.exp(-2)) < 0.005
    df = spark.createDataFrame([(int(v),) for v in h[:500]], "h long").select("h", FO.bag_weight_column("h", 57).alias("w"))
    got = df.collect()
    assert [r.w for r in got] == FO.bag_weights(np.array([r.h for r in got]), 57).tolist()


def test_cuts_are_exact_quantiles(spark):
    rng = np.random.default_rng(9)
    cols = {
        "plain": rng.normal(size=5000), "few": rng.integers(0, 3, 5000).astype(float), "one": np.full(5000, 7.0), "wide": np.exp(rng.normal(0, 40, 5000)),
        "huge": np.where(np.arange(5000) % 2, -1.7e308, 1.7e308), "gaps": np.where(rng.random(5000) < 0.2, np.nan, rng.normal(size=5000) * 1e-300), "hot": np.where(rng.random(5000) < 0.4, 0.5, rng.random(5000)),
    }
    rows = [tuple(None if name == "gaps" and math.isnan(v[i]) and i % 2 else float(v[i]) for name, v in cols.items()) for i in range(5000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = FO.quantile_cuts(df, list(cols), 16)
    for name, v in cols.items():
        v = np.sort(v[~np.isnan(v)])
        want = sorted({float(v[max(1, -(-k * len(v) // 16)) - 1]) for k in range(1, 16)} - {float(v[0])})
        assert got[name] == want, name
    assert FO.quantile_cuts(df.limit(0), ["plain", "one"], 16) == {"plain": [], "one": []}


def test_binned_rows(table, binned):
    assert binned.encoded == ["a", "b", "c=u", "c=v", "c=w"] and binned.source == ["a", "b", "c", "c", "c"]
    by_hash = {r.h: r for r in table.withColumn("h", key_hash(["k"], table)).collect()}
    rows = binned.rows.collect()
    assert len(rows) == table.filter("y is not null").count()
    for r in rows:
        given = by_hash[r.h]
        for value, name, at in ((given.a, "a", r.x0), (given.b, "b", r.x1)):
            missing = value is None or math.isnan(value)
            assert at == (len(binned.cuts[name]) + 1 if missing else sum(c <= value for c in binned.cuts[name]))
        assert [r.x2, r.x3, r.x4] == [int(given.c == v) for v in "uvw"]


@pytest.mark.parametrize("bagged, tried", [(True, None), (False, 5)])
def test_trees_equal_plain_search(binned, monkeypatch, bagged, tried):
    h, y, x = matrix(binned)
    trees = FO.grow(binned, 6, depth=4, tried=tried, bagged=bagged)
    for t, tree in enumerate(trees):
        want = plain_tree(t, h, y, x, binned.width, 4, tried or 3, bagged)
        got = {n: [int(tree.feature[n]), int(tree.cut[n]), float(tree.value[n])] for n in want}
        assert got == want
        assert all(tree.feature[n] < 0 for n in range(1, 32) if n not in want)
    # One tree at a time gives the same as many.
    monkeypatch.setattr(FO, "COUNTER_BYTES", 1)
    assert same_trees(trees, FO.grow(binned, 6, depth=4, tried=tried, bagged=bagged))


def test_partitions_change_nothing(table):
    results = []
    for n in (4, 64):
        b = FO.bin_features(table.repartition(n), SPEC, ["k"])
        trees = FO.grow(b, 8)
        results.append((b.cuts, trees, sorted(map(tuple, FO.oob_error_curve(b, trees, (1, 8)).collect())), sorted(map(tuple, FO.oob_importance(b, trees).collect()))))
    assert results[0][0] == results[1][0] and same_trees(results[0][1], results[1][1])
    assert results[0][2:] == results[1][2:]


def test_error_curve_equals_recount(binned):
    h, y, x = matrix(binned)
    trees = FO.grow(binned, 12, depth=3)
    got = {r.trees: r for r in FO.oob_error_curve(binned, trees, (1, 3, 12, 99)).collect()}
    assert sorted(got) == [1, 3, 12]
    for k, r in got.items():
        n, wrong = [0, 0], [0, 0]
        for i in range(len(h)):
            votes = [int(trees[t].value[trees[t].route(x[i : i + 1])][0] > 0.5) for t in range(k) if FO.bag_weights(h[i : i + 1], t)[0] == 0]
            if votes:
                n[y[i]] += 1
                wrong[y[i]] += (sum(votes) > len(votes) / 2) != y[i]
        assert r.n == sum(n)
        assert [r.error, r.error_0, r.error_1] == [sum(wrong) / sum(n), wrong[0] / n[0], wrong[1] / n[1]]


def test_importance_equals_plain_loop(binned, monkeypatch):
    monkeypatch.setattr(FO, "PERMUTED_ROWS", 250)
    h, y, x = matrix(binned)
    trees = FO.grow(binned, 5, depth=3)
    groups = {"a": [0], "b": [1], "c": [2, 3, 4]}
    buckets = -(-len(h) // 250)
    lost, out, gini = {c: [0] * 5 for c in groups}, [0] * 5, dict.fromkeys(groups, 0.0)
    for bucket in range(buckets):
        rows = sorted((tuple([h[i], y[i], *x[i]]) for i in range(len(h)) if h[i] % buckets == bucket))
        hb, yb, xb = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
        for t, tree in enumerate(trees):
            own = [i for i in range(len(rows)) if FO.bag_weights(hb[i : i + 1], t)[0] == 0]
            out[t] += len(own)
            for f, (c, at) in enumerate(groups.items()):
                order = np.random.default_rng([FO.SEED, bucket, t, f]).permutation(len(own))
                for place, i in enumerate(own):
                    mixed = xb[i].copy()
                    mixed[at] = xb[own[order[place]]][at]
                    lost[c][t] += int(tree.votes(xb[i : i + 1])[0] == yb[i]) - int(tree.votes(mixed[None])[0] == yb[i])
    for c, at in groups.items():
        gini[c] = sum(g for tree in trees for node, g in tree.gain.items() if tree.feature[node] in at) / 5
    got = {r.feature: r for r in FO.oob_importance(binned, trees).collect()}
    for c in groups:
        d = np.array(lost[c]) / np.array(out)
        assert abs(got[c].accuracy_drop - d.mean()) < 1e-12
        assert abs(got[c].standard_error - math.sqrt(max((d * d).mean() - d.mean() ** 2, 0) / 5)) < 1e-9
        assert abs(got[c].gini_drop - gini[c]) < 1e-9
    assert got["a"].accuracy_drop > 0


def test_one_class_and_empty_tables(spark, table):
    one = FO.bin_features(table.withColumn("y", F.lit(1)), SPEC, ["k"])
    trees = FO.grow(one, 3)
    assert all(t.feature[1] == -1 and t.value[1] == 1.0 for t in trees)
    assert [r.error for r in FO.oob_error_curve(one, trees, (3,)).collect()] == [0.0]
    assert {r.z for r in FO.oob_importance(one, trees).collect()} == {None}
    none = FO.bin_features(table.limit(0), SPEC, ["k"])
    trees = FO.grow(none, 2)
    assert FO.oob_error_curve(none, trees, (2,)).collect() == [] == FO.oob_importance(none, trees).collect()


def test_scored_forest_equals_its_trees(table):
    """The expression gives the same leaves as the grown trees, missing values included."""
    b = FO.bin_features(table, SPEC, ["k"], bins=8)
    trees = FO.grow(b, 5, depth=4)
    model = FO.forest_model(b, SPEC, trees)
    by_hash = {r.h: list(r)[2:] for r in b.rows.collect()}
    scored = model.transform(table.filter("y is not null").withColumn("h", key_hash(["k"], table))).collect()
    for r in scored:
        x = np.array([by_hash[r.h]])
        p = sum(float(t.value[t.route(x)][0]) for t in trees) / 5
        assert abs(r.probability[1] - p) < 1e-12 and r.prediction == float(p > 0.5) and abs(r.probability[0] + p - 1) < 1e-12
    assert abs(sum(model.gains().values()) - 1) < 1e-9


def test_fits_do_not_depend_on_partitions(spark, table):
    from strata.operators import ml as ML

    whole = table.filter("y is not null").dropna()
    # Enough rows for Spark's own sampling of split candidates.
    many = whole.crossJoin(spark.range(20)).select((F.col("k") * 20 + F.col("id")).alias("k"), "a", "b", "c", "y")
    scores = []
    for n in (4, 64):
        models = ML.fit_all(many.repartition(n), SPEC, ["Decision Tree", "Random Forest", "Gradient Boosted Trees"])
        assert models["Decision Tree"].stages[-1].numNodes > 5
        scored = ML.score_all(models, whole, SPEC, ["k"]).collect()
        scores.append(sorted((r.model, r.k, r.prediction, round(r.probability_1, 9)) for r in scored))
    assert scores[0] == scores[1]


def test_source_of_encoded_names():
    from strata.operators import ml as ML

    spec = FeatureSpec("y", ["a", "a__b"], ["a__c"])
    assert [ML.source_of(c, spec) for c in ("a", "a__bin", "a__b", "a__b__bin", "a__c__ohe_u__v")] == ["a", "a", "a__b", "a__b", "a__c"]


def test_bin_sql_counts_cut_points(spark):
    from strata.operators.ml import bin_sql

    cuts = [-2.5, 0.0, 1e-300, 7.0, 1e300]
    values = [-3.0, -2.5, -1.0, 0.0, 1e-301, 1e-300, 6.9, 7.0, 1e300, None, math.nan, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.selectExpr(bin_sql("v", cuts)).collect()]
    assert got == [float(len(cuts) + 1) if v is None or math.isnan(v) else float(sum(c <= v for c in cuts)) for v in values]


def test_equal_rows_walk_a_tree_once(monkeypatch):
    """Rows of the same bins and label are one row to a tree; each keeps its own draw."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    kinds = rng.integers(0, 6, (9, 3))
    x = np.repeat(kinds, 200, axis=0)
    h, y = rng.integers(0, FO.MODULUS, len(x)), np.repeat(rng.integers(0, 2, 9), 200)
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(y), *(pa.array(x[:, i]) for i in range(3))], names=["h", "y", "x0", "x1", "x2"])
    walked = []
    route = FO.Tree.route
    monkeypatch.setattr(FO.Tree, "route", lambda tree, rows: walked.append(len(rows)) or route(tree, rows))
    trees = {t: FO.Tree.empty(2) for t in range(4)}
    got = {}
    for out in FO._count_bins(trees, {t: [1] for t in trees}, 3, 3, 8, True, 7)(iter([batch])):
        for r in out.to_pylist():
            got[r["tree"], r["feature"], r["bin"]] = (r["n"], r["s"])
    for t in trees:
        w = FO.bag_weights(h, t).astype(int)
        for f in range(3):
            for b in np.unique(x[:, f]):
                at = x[:, f] == b
                assert got.get((t, f, b), (0, 0)) == (w[at].sum(), (w * y)[at].sum())
    assert max(walked) <= 9


def test_ballots_vote_as_the_trees_do():
    rng = np.random.default_rng(3)
    for depth in (0, 1, 3, 5, 7):
        tree = FO.Tree.empty(depth)
        tree.value[:] = rng.random(len(tree.value))
        tree.feature[1 : 1 << depth] = rng.integers(-1, 4, (1 << depth) - 1)
        for node in range(2, 1 << depth):
            tree.feature[node] = tree.feature[node] if tree.feature[node // 2] >= 0 else -1
        tree.cut[:] = rng.integers(0, 9, len(tree.cut))
        x = rng.integers(0, 10, (500, 4))
        assert FO.Ballot.of(tree, 10).votes(x).tolist() == (tree.votes(x) == 1).tolist()


def test_trees_are_fitted_on_weighted_combinations(spark, table):
    """As many rows as bins, levels and labels combine, however often the rows are repeated; the same trees."""
    from strata.operators import ml as ML

    whole = table.filter("y is not null").dropna()
    many = whole.crossJoin(spark.range(7)).drop("id")
    sizes, scores = [], []
    for df in (whole, many):
        cuts = FO.quantile_cuts(df, SPEC.numeric, 6)
        labelled = ML.with_label(df, SPEC)
        encoding = ML.Pipeline(stages=ML.feature_stages(SPEC, cuts)).fit(labelled)
        cells = ML.binned_cells(labelled, encoding, SPEC, cuts).cache()
        sizes.append((cells.count(), cells.agg(F.sum("weight")).first()[0]))
        tree = ML.estimators()["Decision Tree"]
        alone = tree.fit(encoding.transform(labelled).select("binned", "label"))
        both = [m.toDebugString.split("\n")[1:] for m in (alone, tree.copy({tree.weightCol: "weight"}).fit(cells))]
        assert both[0] == both[1] and len(both[0]) > 5
    n = whole.count()
    assert sizes == [(sizes[0][0], n), (sizes[0][0], 7 * n)] and sizes[0][0] < n
