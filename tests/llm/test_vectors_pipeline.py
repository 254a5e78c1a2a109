"""Vector search against brute force; the pipeline stage by stage."""

import math
from collections import Counter

import corpus_pipeline as CP
import numpy as np
from conftest import SF_MID

from strata.llm import vector_search as VS


def brute(rows, queries, k):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok.setdefault(len(v), []).append((i, np.array(v, dtype=np.float32).astype(np.float64)))
    out = []
    for dim in ok.values():
        for i, q in dim:
            if i in queries:
                best = sorted((float(np.sqrt(((x - q) ** 2).sum())), j) for j, x in dim if j != i)[:k]
                out += [(i, r + 1, j, d) for r, (d, j) in enumerate(best)]
    return out


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, r = rng.normal(size=(20, 48)), rng.normal(size=(300, 48)) * rng.uniform(0.01, 30, (300, 1))
    r[:20] = q
    d = np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2))
    for size in (1.0, 1e200, 1e-200):
        low, high, unit = VS.bounds(VS.encode(q * size), VS.encode(r * size))
        assert (low * unit / size <= d).all() and (d <= high * unit / size).all()
        assert np.allclose(VS.distances(r * size, q[0] * size) / size, d[0], rtol=1e-12)


def test_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0")
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = brute(data, {i for i, _ in data if i % 20 == 0}, 10)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in VS.nearest(rows, asked).collect()]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    assert np.allclose([x[3] for x in sorted(got)], [x[3] for x in sorted(want)], rtol=1e-12)


def test_large_and_tiny_components(spark, monkeypatch):
    """Finite components of any size have all their neighbours, whatever shares their block."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * s).tolist()) for i, s in enumerate([1e200, 1e-200, 1.0, 1e200, 1e-160, 1e150] * 12)]
    rows += [(100, [1e200] * 5 + [0.0]), (101, [1e200] * 5 + [1.0]), (102, [1e200] * 5 + [3.0]), (103, [1.7e308] * 6), (104, [-1.7e308] * 6)]

    def far(a, b):
        d = [x - y for x, y in zip(a, b)]
        return math.inf if any(map(math.isinf, d)) else math.hypot(*d)

    want = {}
    for i, v in rows:
        want[i] = sorted((far(v, w), j) for j, w in rows if j != i)[:5]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for blocks, kept in ((4096, 65536), (7, 1)):
        monkeypatch.setattr(VS, "ROW_BLOCK", blocks)
        monkeypatch.setattr(VS, "QUERY_BLOCK", blocks)
        monkeypatch.setattr(VS, "HELD_QUERIES", kept)
        got = {}
        for r in VS.nearest(df, df, k=5).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert set(got) == set(want)
        for i, best in want.items():
            assert [j for _, j in got[i]] == [j for _, j in best] or np.allclose([d for d, _ in got[i]], [d for d, _ in best], rtol=1e-12, atol=0)
            assert np.allclose([d for d, _ in got[i]], [d for d, _ in best], rtol=1e-12, atol=0)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (10, []), (None, [1.0, 1.0])]
    data += [(i, [1.0, 0.0]) for i in range(20, 60)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], "vec_id long, embedding array<float>, rank string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in VS.nearest(df, df.filter("vec_id % 2 = 0"), k=5).collect()]
    assert sorted(got) == sorted(brute(data, {i for i, _ in data if i is not None and i % 2 == 0}, 5))
    assert VS.nearest(df.limit(0), df).collect() == [] and VS.nearest(df, df.limit(0)).collect() == []


def test_pipeline_stages(spark):
    assert [n for n, _ in CP.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    before = docs
    for name, stage in CP.STAGES[:-1]:
        after = CP.materialize(stage(spark, before, SF_MID), name)
        assert after.columns == docs.columns, name
        assert after.count() <= before.count()
        if name == "line_dedup":
            assert after.count() == before.count()
        before = after
    pieces = CP.STAGES[-1][1](spark, before, SF_MID)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in before.collect()}


def test_stages_with_clashing_names(spark):
    """Extra columns may have any name."""
    names = ["lost_id", "lost_key", "LOST_AT", "leak_id", "leak_key", "decided_id", "count", "kept", "component_id", "score"]
    rows = [(i, f"some words {i % 3} that stand here and there in text {i}", *[str(i)] * len(names)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in CP.STAGES[:-1]:
        out = stage(spark, df, SF_MID)
        assert out.columns == df.columns, name
        assert all(r.count_ == str(r.doc_id) for r in out.withColumnRenamed("count", "count_").collect())
    assert CP.STAGES[-1][1](spark, df, SF_MID).count() == 12


def test_stages_on_odd_tables(spark):
    rows = [(1, "a b c d e f g", None, "s", 3, "k"), (1, "a b c d e f g", None, "s", 3, "k"), (2, None, None, None, None, None), (None, "a b c d e f g", "en", "s", 1, "k"), (3, "", "en", "s", 0, "k"), (4, "a B c D e F g", "en", "s", 9, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    near = CP.drop_near_duplicates(spark, df, SF_MID)
    assert near.columns == df.columns
    assert Counter(r.doc_id for r in near.collect()) == Counter([1, 2, None, 3])
    for _, stage in CP.STAGES:
        assert stage(spark, df.limit(0), SF_MID).collect() == []
    for _, stage in CP.STAGES[:-1]:
        assert set(stage(spark, df, SF_MID).columns) == set(df.columns)


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """The queries' copies, one for each group of rows, are shuffled; all parts of them meet all rows."""
    monkeypatch.setattr(VS, "QUERY_BLOCK", 8)
    monkeypatch.setattr(VS, "ROW_BLOCK", 64)
    monkeypatch.setattr(VS, "PART_BLOCKS", 2, raising=False)
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet")
    found = VS.nearest(rows, rows.filter("vec_id % 10 = 0"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    data = [(r.vec_id, r.embedding) for r in rows.collect()]
    want = brute(data, {i for i, _ in data if i % 10 == 0}, 10)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found.collect()) == sorted(x[:3] for x in want)
