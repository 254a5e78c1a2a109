"""Ranked lexical search against a plain version."""

import math
import re
from collections import Counter

import numpy as np
from conftest import SF_SMALL

from strata.llm import lexical_search as LS

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def fold(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    held = [(i, Counter(fold(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for item, text in sorted({(i, t) for i, t in items if i is not None and t is not None}):
        asked.setdefault(item, Counter()).update(fold(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, total)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def run(docs, items, **more):
    return sorted(tuple(r) for r in LS.search(docs, items, **more).collect())


def test_given_tables_equal_plain(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    want = plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert run(docs, items) == want
    # Several passes over parts of the items, and other partitions, give the same rows.
    assert run(docs.repartition(7), items, item_bytes=2000) == want


def test_odd_rows_equal_plain(spark):
    docs = [
        (0, None), (1, ""), (2, "-- !!"), (3, "Alpha alpha BETA"), (3, "Alpha alpha BETA"), (3, "gamma"), (None, "alpha gamma delta"),
        (5, "É é ÉCOLE école"), (6, "a_b c[d]e a`b {x}"), (7, "alpha " * 5000 + "zeta"), (8, "beta alpha"), (9, "alpha beta"), (10, "İstanbul Kelvin k"),
    ]
    docs += [(i, "tie breaker words") for i in range(40, 20, -1)] + [(i, f"filler {i}") for i in range(100, 140)]
    items = [(1, "alpha beta beta"), (1, "alpha beta beta"), (2, None), (3, ""), (None, "alpha"), (4, "breaker TIE"), (5, "nowhere"), (6, "É a B d x"), (7, "gamma"), (7, "delta"), (8, "Kelvin K")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, n int")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    assert run(df, asked) == plain(docs, items)
    assert run(df.repartition(5), asked, k=3) == plain(docs, items, 3)
    assert run(df.limit(0), asked) == [] and run(df, asked.limit(0)) == []


def test_many_terms_and_blocks(monkeypatch):
    """Masks of over 64 terms, small blocks: the same as scoring everything."""
    rng = np.random.default_rng(3)
    words = 150
    n = rng.integers(1, 400, 600)
    held = [rng.choice(words, rng.integers(0, 90), replace=False) for _ in n]
    times = [rng.integers(1, 9, len(h)) for h in held]
    docs, total = 600, int(n.sum())
    weights = rng.integers(0, 9000, words)
    best, seen = (np.empty(0, dtype=np.int64),) * 2, 0
    exact = []
    for at in range(0, 600, 50):
        part = range(at, at + 50)
        offsets = np.concatenate([[0], np.cumsum([len(held[i]) for i in part])])
        block = LS.Block(np.arange(at, at + 50), n[at : at + 50], offsets, np.concatenate([held[i] for i in part]), np.concatenate([times[i] for i in part]), docs, total, words)
        best = LS.improve(block, np.arange(words), weights, weights, best, 10)
        m = LS.damping(n[at : at + 50], docs, total)
        exact += [(-sum(int(weights[t]) * (10**9 * int(f) // (1000 * int(f) + 8 * int(m[i - at]))) for t, f in zip(held[i], times[i])), i) for i in part]
        seen += 1
    assert list(zip((-best[0]).tolist(), best[1].tolist())) == sorted(exact)[:10]


def test_damping_beyond_64_bits():
    n = np.array([10**9, 3])
    assert LS.damping(n, 10**12, 10**15).tolist() == [25 + 75 * x * 10**12 // 10**15 for x in (10**9, 3)]
