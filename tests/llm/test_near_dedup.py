"""Near-duplicates against brute force over all pairs."""

import re
from collections import Counter

import numpy as np
from conftest import SF_SMALL

from strata.llm import near_dedup as ND
from strata.llm.components import connected_components
from strata.llm.text import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.translate({i: i + 32 for i in range(65, 91)})


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = ND.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {tuple(r) for r in got.collect()} == want


def test_chained_edits_and_hot_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 80)]
    rows, n = [], 0
    for _ in range(150):  # near copies of one text, each with its own edits
        w = list(base)
        for at in rng.integers(0, 80, rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 9999)}"
        rows.append((n, " ".join(w)))
        n += 1
    w = list(base)
    for _ in range(40):  # a chain: each link is similar to the one before only
        w = w[2:] + [f"y{rng.integers(0, 9999)}", f"z{rng.integers(0, 9999)}"]
        rows.append((n, " ".join(w)))
        n += 1
    got = {tuple(r) for r in ND.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    long_text = "lorem ipsum dolor sit amet " * 30_000
    rows = [
        (None, "a b c d e f", "s"), (1, None, None), (2, "", None), (3, " \t\n", None), (4, "One two", "k"),
        (5, "one TWO", "k"), (6, long_text, "k"), (6, long_text, "k"), (7, "É é", "k"), (8, "é É", None), (9, "a b c d e f", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = Counter(tuple(r) for r in ND.near_duplicates(df).collect())
    assert got == Counter([
        (None, 2, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 5, 6, True), (6, 5, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 2, 9, True),
    ])
    assert ND.near_duplicates(df.limit(0)).collect() == []


def test_estimate_is_close(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(30):
        both = rng.integers(0, 2**63, 600, dtype=np.uint64)
        x, y = np.unique(np.r_[both[:400], both[400:500]]), np.unique(np.r_[both[:400], both[500:]])
        rows.append(tuple(ND.pack(ND.minima(s)).view(np.int64).tolist() for s in (x, y)))
        want.append(400 / 600)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").select(ND.estimate("a", "b").alias("e"))
    assert abs(np.mean([r.e for r in df.collect()]) - np.mean(want)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(61)} | {(i, 100) for i in (100, 101, 103)}


def test_shingles_agree_with_plain_rule():
    for t in ("a b", "A B c D e f g", "x " * 9, "é b c", ""):
        assert len(shingle_set(t.encode())) == len(shingles(t))


def test_one_id_on_different_texts(spark):
    """Rows of one id are one node: whatever any of its texts is like hangs together."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(9)]

    def near(k):
        w = texts[k].split()
        w[int(rng.integers(0, 30))] = f"e{rng.integers(0, 999)}"
        return " ".join(w)

    rows = [(3, texts[0]), (5, near(0)), (5, texts[1]), (9, near(1)), (9, texts[2]), (7, near(2)), (7, None), (20, texts[3]), (20, texts[4]), (2, ""), (2, texts[5]), (8, near(5))]
    rows += [(4, texts[6]), (4, texts[7]), (11, texts[7]), (12, near(6)), (6, texts[8]), (6, texts[8]), (1, None), (1, "")]
    rows += [(30 + i, near(2)) for i in range(12)] + [(40, near(2)), (40, near(4)), (40, texts[0])]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingles(t) for _, t in rows]
    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    want = Counter((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ND.near_duplicates(df).collect()) == want
    assert Counter(tuple(r) for r in ND.near_duplicates(df.repartition(6)).collect()) == want
