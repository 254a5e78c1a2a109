import math

import numpy as np
from pyspark.sql import functions as F

from strata.operators import evaluate as EV
from strata.operators import stats as ST


def test_zscore_sample_sd_and_constant_policy(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 5.0)], "k int, x double, c double")
    nan = {r.k: (r.x, r.c) for r in ST.zscore(df, ["x", "c"]).collect()}
    assert nan[1][0] == -1.0 and nan[3][0] == 1.0  # sd = 1 (sample)
    assert math.isnan(nan[2][1])
    zero = {r.k: r.c for r in ST.zscore(df, ["x", "c"], constant="zero").collect()}
    assert zero == {1: 0.0, 2: 0.0, 3: 0.0}


def test_zscore_fit_on_other_frame(spark):
    train = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    test = spark.createDataFrame([(4.0,)], "x double")
    assert ST.zscore(test, ["x"], fit_on=train).collect()[0].x == (4.0 - 1.0) / math.sqrt(2.0)


def _loess_numpy(x, y, gx, span):
    n = len(x)
    q = int(span * n)
    d = np.abs(x - gx)
    h = np.sort(d)[q - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
    dx = x - gx
    X = np.vstack([np.ones(n), dx, dx * dx]).T
    beta = np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y))
    return beta[0]


def test_loess_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(1, 40, 300).astype(float)
    y = 3 + 0.5 * x - 0.01 * x * x + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.g: (r.x, r.fit) for r in ST.loess_trend(df, "x", "y", span=0.75, points=10).collect()}
    assert len(got) == 10
    for g, (gx, fit) in got.items():
        assert abs(fit - _loess_numpy(x, y, gx, 0.75)) < 1e-6


def test_loess_range_filter(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(100)], "x double, y double")
    got = ST.loess_trend(df, "x", "y", points=5, xlim=(10, 50)).collect()
    assert min(r.x for r in got) == 10.0 and max(r.x for r in got) == 50.0
    for r in got:  # a straight line is reproduced exactly
        assert abs(r.fit - r.x) < 1e-6


def _scores(spark):
    rows = [
        ("m", 1, 0.9, 1.0), ("m", 1, 0.8, 1.0), ("m", 0, 0.8, 1.0), ("m", 0, 0.3, 0.0),
        ("m", 1, 0.3, 0.0), ("m", 0, 0.1, 0.0), ("m", 0, 0.1, 0.0),
    ]
    return rows, spark.createDataFrame(rows, "model string, y int, p1 double, prediction double")


def test_auc_hard_is_mean_of_tpr_tnr(spark):
    rows, df = _scores(spark)
    tp = sum(1 for r in rows if r[1] == 1 and r[3] == 1.0)
    tn = sum(1 for r in rows if r[1] == 0 and r[3] == 0.0)
    pos = sum(r[1] for r in rows)
    want = (tp / pos + tn / (len(rows) - pos)) / 2 * 100
    assert abs(EV.auc_hard(df, "y", "prediction").collect()[0].auc - want) < 1e-9


def test_auc_ranked_matches_pairwise_count(spark):
    rows, df = _scores(spark)
    pos = [r[2] for r in rows if r[1] == 1]
    neg = [r[2] for r in rows if r[1] == 0]
    pairs = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    want = pairs / (len(pos) * len(neg)) * 100
    assert abs(EV.auc_ranked(df, "y", "p1").collect()[0].auc - want) < 1e-9


def test_accuracy_and_metrics_long(spark):
    rows, df = _scores(spark)
    want = sum(1 for r in rows if (1.0 if r[2] > 0.5 else 0.0) == r[1]) / len(rows) * 100
    assert abs(EV.accuracy(df, "y", "p1").collect()[0].accuracy - want) < 1e-9
    long = {r.metric for r in EV.metrics_long(df, "y", "prediction").collect()}
    assert long == {"AUC", "Accuracy"}


def test_lift_properties(spark):
    rows = [("a", int(i % 3 == 0), (i * 7919) % 1000 / 1000.0, i) for i in range(997)]
    df = spark.createDataFrame(rows, "model string, y int, p1 double, key int")
    lift = EV.lift_table(df, "y", "p1", ["key"]).collect()
    mine = sorted((r.bin, r.prop) for r in lift if r.model == "a")
    assert [b for b, _ in mine] == list(range(1, 11))
    props = [p for _, p in mine]
    assert all(b >= a - 1e-12 for a, b in zip(props, props[1:]))
    assert abs(props[-1] - 1.0) < 1e-12
    base = sorted((r.bin, r.prop) for r in lift if r.model == "Base")
    assert base[0] == (1, 0.0) and base[-1] == (10, 1.0) and abs(base[1][1] - 1 / 9) < 1e-12


def test_deciles_handle_n_not_divisible(spark):
    df = spark.createDataFrame([("m", i, float(i)) for i in range(23)], "model string, key int, p1 double")
    bins = {r.key: r.bin for r in EV.decile_assign(df, "p1", ["key"]).collect()}
    sizes = [sum(1 for b in bins.values() if b == k) for k in range(1, 11)]
    assert sizes == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]
    assert bins[22] == 1 and bins[0] == 10
    assert F is not None


def test_loess_row_level_path_equals_distinct_path(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.integers(1, 30, 200).astype(float)
    y = np.sin(x / 5) + rng.normal(0, 0.1, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fast = {r.g: r.fit for r in ST.loess_trend(df, "x", "y", points=7).collect()}
    monkeypatch.setattr(ST, "MAX_DISTINCT_X_FOR_WINDOW", 0)
    slow = {r.g: r.fit for r in ST.loess_trend(df, "x", "y", points=7).collect()}
    assert set(fast) == set(slow)
    for g in fast:
        assert abs(fast[g] - slow[g]) < 1e-9


def test_bin2d_counts_every_row_once(spark):
    rows = [(float(i % 10), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double")
    cells = ST.bin2d(df, "x", "y", (5, 4)).collect()
    assert sum(r.n for r in cells) == 100
    assert max(r.x_bin for r in cells) == 4 and max(r.y_bin for r in cells) == 3


def test_zscore_by_equals_separate_fits(spark):
    rows = [("a", float(i), 5.0) for i in range(5)] + [("b", float(i * i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "p string, x double, c double")
    grouped = {(r.p, r.x is not None and round(r.x, 12)) for r in ST.zscore_by(df, ["x"], ["p"]).select("p", "x").collect()}
    separate = set()
    for p in ("a", "b"):
        part = df.filter(F.col("p") == p)
        separate |= {(r.p, round(r.x, 12)) for r in ST.zscore(part, ["x"]).select("p", "x").collect()}
    assert grouped == separate
    consts = [r.c for r in ST.zscore_by(df, ["c"], ["p"]).collect()]
    assert all(math.isnan(v) for v in consts)


def _plain_interpolated(x, y, grid, span=0.75, cell=0.2):
    """Cells cut in the middle of sorted points, a fit at each end, cubics between."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    cuts, open_ = [], [(0, len(x))]
    while open_:
        a, b = open_.pop()
        if b - a <= max(1, int(len(x) * span * cell)):
            continue
        middle = (a + 1 + b) // 2
        places = [r for r in range(a + 1, b) if x[r - 1] != x[r]]
        if places:
            r = min(places, key=lambda r: (abs(r - middle), -r))
            cuts.append((x[r - 1] + x[r]) / 2)
            open_ += [(a, r), (r, b)]
    margin = ST.BOX_MARGIN * max(x[-1] - x[0], max(abs(x[0]), abs(x[-1])) * 1e-3 + 1e-30)
    v = [x[0] - margin, *sorted(cuts), x[-1] + margin]
    fits = []
    for g in v:
        d = np.abs(x - g)
        h = np.sort(d)[int(span * len(x)) - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        X = np.vstack([np.ones(len(x)), x - g, (x - g) ** 2]).T
        fits.append(np.linalg.solve(X.T @ (w[:, None] * X), X.T @ (w * y))[:2])
    out = []
    for z in grid:
        i = max(k for k in range(len(v) - 1) if v[k] <= z)
        (f0, d0), (f1, d1), wide = fits[i], fits[i + 1], v[i + 1] - v[i]
        t = (z - v[i]) / wide
        out.append((1 - t) ** 2 * (1 + 2 * t) * f0 + t * t * (3 - 2 * t) * f1 + (t * (1 - t) ** 2 * d0 - t * t * (1 - t) * d1) * wide)
    return out


def test_interpolated_loess_equals_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(11)
    for x in (rng.normal(0, 3, 250), rng.integers(0, 12, 250).astype(float), np.where(rng.random(250) < 0.4, 2.0, rng.random(250) * 5)):
        y = np.sin(x) + rng.normal(0, 0.1, len(x))
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
        got = sorted(ST.loess_trend(df.repartition(5), "x", "y", surface="interpolate").collect())
        assert np.allclose([r.fit for r in got], _plain_interpolated(x, y, [r.x for r in got]), atol=1e-7)
        with monkeypatch.context() as m:
            m.setattr(ST, "MAX_DISTINCT_X_FOR_WINDOW", 0)
            again = sorted(ST.loess_trend(df, "x", "y", surface="interpolate").collect())
        assert np.allclose([r.fit for r in got], [r.fit for r in again], atol=1e-9)


def test_loess_ignores_nan_and_limits_both_axes(spark):
    rows = [(float(i % 40), float(i % 40) + (i % 3), "a") for i in range(400)]
    clean = spark.createDataFrame(rows, "x double, y double, g string")
    odd = clean.unionByName(spark.createDataFrame([(5.0, math.nan, "b"), (math.nan, 5.0, "b"), (None, 1.0, "b"), (3.0, None, "b")], "x double, y double, g string"))
    far = odd.unionByName(spark.createDataFrame([(7.0, 1e6, "c"), (900.0, 7.0, "c")], "x double, y double, g string"))
    for surface in ("direct", "interpolate"):
        want = [(r.x, round(r.fit, 9)) for r in sorted(ST.loess_trend(clean, "x", "y", points=9, surface=surface).collect())]
        assert [(r.x, round(r.fit, 9)) for r in sorted(ST.loess_trend(odd, "x", "y", points=9, surface=surface).collect())] == want
        limited = ST.loess_trend(far, "x", "y", points=9, xlim=(0, 100), ylim=(-5, 100), surface=surface)
        assert [(r.x, round(r.fit, 9)) for r in sorted(limited.collect())] == want
    assert ST.loess_trend(clean.limit(0), "x", "y", surface="interpolate").collect() == []


def test_order_statistics(spark):
    from strata.operators.ranks import order_statistics

    values = [5.0, 5.0, 1.0, None, math.nan, -math.inf, math.inf, 5.0]
    df = spark.createDataFrame([(v, 2.0) for v in values], "a double, b double")
    got = order_statistics(df.repartition(3), {"a": [0, 1, 2, 3, 5, 6, 7], "b": lambda n: [n]})
    assert got == {"a": {1: -math.inf, 2: 1.0, 3: 5.0, 5: 5.0, 6: math.inf}, "b": {8: 2.0}}
