"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest
from conftest import SF_MID

from strata.llm import embedding_dedup as ED


def brute(rows, cosine=0.9):
    """One entry per row; rows of one id are one node."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    parent = {k: k for k, _ in rows if k is not None}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    unit = {i: ED.unit(np.array([rows[i][1]], dtype=np.float64))[0] for i in good}
    for n, i in enumerate(good):
        for j in good[:n]:
            if len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = top(rows[i][0]), top(rows[j][0])
                parent[max(x, y)] = min(x, y)
    out = []
    for i, (k, _) in enumerate(rows):
        c = None if k is None else top(k) if i in unit else k
        out.append((k, links[i], c, k is None or k == c))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def run(df):
    return order([tuple(r) for r in ED.linked_vectors(df).collect()])


def test_collision_probability_and_plan():
    rng = np.random.default_rng(1)
    c = math.sqrt(0.2)
    a = rng.standard_normal(200_000)
    shift = rng.uniform(0, ED.WIDTH, len(a))
    same = np.floor(shift / ED.WIDTH) == np.floor((shift + c * a) / ED.WIDTH)
    assert abs(same.mean() - ED.collision(c)) < 0.005
    for n in (1, 100, 10**6, 10**9):
        wide, tables = ED.plan(n)
        assert (1 - ED.collision(c) ** wide) ** tables <= ED.MISS
        assert n * ED.collision(math.sqrt(2)) ** wide <= ED.COMPANY or wide == 4


def test_recall_at_the_threshold():
    """Pairs at cosine 0.9 to 0.91, the hardest there are."""
    rng = np.random.default_rng(7)
    x = ED.unit(rng.standard_normal((3000, 64)))
    away = rng.standard_normal(x.shape)
    away = ED.unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    c = rng.uniform(0.9, 0.91, (len(x), 1))
    y = c * x + np.sqrt(1 - c * c) * away
    wide, tables = ED.plan(2 * len(x))
    met = (ED.bucket_keys(x, wide, tables) == ED.bucket_keys(y, wide, tables)).any(axis=1)
    assert met.mean() > 0.97


def test_given_vectors_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    assert run(df) == order(brute(rows))


@pytest.mark.parametrize("tile", [1024, 20])
def test_groups_of_near_copies(spark, monkeypatch, tile):
    """Exact copies, a large group of near copies, chains; whole and cut into blocks."""
    monkeypatch.setattr(ED, "TILE", tile)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((6, 24))
    rows = [(i, centre[0].tolist()) for i in range(90, 60, -1)]
    rows += [(100 + i, (centre[1] + 0.08 * rng.standard_normal(24)).tolist()) for i in range(150)]
    rows += [(300 + i, (centre[2] * (i + 1)).tolist()) for i in range(20)]
    turn = [math.cos(0.4 * i) * centre[3] / np.linalg.norm(centre[3]) + math.sin(0.4 * i) * ED.unit((centre[4] - centre[4] @ centre[3] / (centre[3] @ centre[3]) * centre[3])[None])[0] for i in range(12)]
    rows += [(500 - i, v.tolist()) for i, v in enumerate(turn)]
    rows += [(600 + i, rng.standard_normal(24).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df.repartition(4)) == order(brute(rows))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0, 0.0]), (7, [2.0, 0.01]), (8, [-1.0, 0.0]),
        (9, [1.0]), (10, [3.0]), (11, []), (None, [1.0, 0.0]), (12, [1e200, 0.0]), (13, [1e-200, 0.0]), (14, [1.0, -0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (20, None), (21, [0.0, 5.0]), (None, None),
    ]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, n_links int")
    assert run(df) == order(brute(rows))
    assert run(df.limit(0)) == []
