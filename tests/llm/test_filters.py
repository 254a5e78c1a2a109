"""Personal data, toxicity, quality, decontamination, urls and lines."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import SF_MID, SF_SMALL
from pyspark.sql import functions as F

from strata.llm import decontaminate as DC
from strata.llm import line_templates as LT
from strata.llm import pii, quality, toxicity
from strata.llm import url_reputation as UR
from strata.llm.catalogue import LLM_ORACLE, LLM_QUERIES
from strata.llm.store import sample_keys

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".") if kind == "ip"), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    rng = np.random.default_rng(2)
    alphabet = list("0123456789.@+-() ab\u00e9:")
    for _ in range(4000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("1.2.3.4.5.6.7.8", "0001.2.3.255", "a@b.c@d.e", "x@y..z", "+1 (555) 123-4567", "4111 1111 1111 1111", "@a.b", "256.1.1.1"):
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []


def test_personal_data_query(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert pii.redact("call +1 555 a@b.c", "phone:5:11,email:12:17") == "call [phone] [email]"


def test_trees_add_loose_forms(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        n = "".join(rng.choice(list("0123456789"), 10))
        rows.append((i, f"call me +1 ({n[:3]}) {n[3:6]}-{n[6:]} from {n[0]}{n[1]}.{n[2]}{n[3]}.7.9 mail joe{i}@mail.example.com order {n}{n[:4]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df, 400)
    assert model is not None
    base, all_ = pii.spans_of("call me 1 (415) 555-2671 now, joe (at) mail.example.com", model)
    assert base == [] and {k for _, k, _ in all_} <= {0, 3}
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "x 9", 3)], "doc_id long, text string, spans int")
    assert [r.spans for r in pii.find_personal_data(odd).collect()] == ["", "", ""]
    assert pii.find_personal_data(odd.limit(0)).collect() == []


def test_toxicity_learns_and_keeps_fold_apart(spark):
    rng = np.random.default_rng(6)
    clean = [f"word{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(1200):
        w = list(rng.choice(clean, 40))
        bad = int(rng.random() < 0.2)
        if bad:
            w[5], w[20] = "Nasty!", f"foul{rng.integers(0, 50)}"
        rows.append((i, " ".join(w), "x"))
        marks.append((i, 1, bad))
    docs = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x"), (None, "nasty", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).toPandas()
    assert len(got) == 1203 and got["score"].between(0, 1).all()
    truth = dict((m[0], m[2]) for m in marks)
    held = got[got["held_out"] & got["doc_id"].isin(truth)]
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.97
    assert set(got.loc[got["held_out"], "doc_id"]) == {i for i in [*truth, 5000, 5001] if zlib.crc32(str(i).encode()) % 4 == 2}
    # Labels of the held-out fold change nothing.
    other = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in marks], "doc_id long, quality int, toxic int")
    again = toxicity.classify(docs, other).toPandas()
    assert sorted(got["score"]) == sorted(again["score"])
    assert toxicity.classify(docs, labels.limit(0)).filter("score = 0.5").count() == 1203
    model = toxicity.fit_on_labels(docs, labels)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == (got["predicted"] == 0).sum()


def test_ftrl_equals_plain_coordinates():
    """One coordinate at a time, in plain numbers."""
    rng = np.random.default_rng(2)
    rows = [(np.unique(rng.integers(0, 30, 6)), int(rng.random() < 0.3)) for _ in range(400)]
    z, n, zb, nb, bias = {}, {}, 0.0, 0.0, 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        sign = 1.0 if z[i] > 0 else -1.0
        return (sign * toxicity.L1 - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            w = {i: weight(i) for i in x.tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in w:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / toxicity.ALPHA * bias
            nb += g * g
            bias = -zb * toxicity.ALPHA / (toxicity.BETA + math.sqrt(nb))
    got, got_bias = toxicity.train(rows)
    assert np.allclose(got[:30], [weight(i) if i in n else 0.0 for i in range(30)], atol=1e-9) and not got[30:].any()
    assert abs(got_bias - bias) < 1e-9


def test_toxicity_sample_follows_from_ids(spark):
    """Repeated ids, several shards, any partitioning: the same model; one shard's weights are its own."""
    rows = [(i, f"calm word{i % 7} text{i % 5}" + (" nasty foul" if i % 4 == 0 else "")) for i in range(400)]
    rows += [(0, "zzz later"), (0, "zzz later"), (8, None), (12, "aaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    want = sorted(toxicity.fit_on_labels(docs, labels, 150))
    assert sorted(toxicity.fit_on_labels(docs.repartition(7), labels.repartition(3), 150)) == want
    one = labels.filter("doc_id = 1")
    alone = dict(toxicity.fit(docs, one.select("doc_id", F.col("toxic").alias("label")), shards=2))
    _, bias = toxicity.train([(np.unique(toxicity.feature_indices(rows[1][1].encode())), 0)])
    assert abs(alone[-1] - bias) < 1e-12


def test_sample_keys(spark):
    keys = spark.range(5000).select(F.col("id").alias("k")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    got = [r.k for r in sample_keys(keys, "k", 300, "s").collect()]
    every = [r.k for r in keys.filter("k is not null").orderBy(F.shiftrightunsigned(F.xxhash64(F.col("k").cast("string"), F.lit("s")), 1), "k").limit(300).collect()]
    assert sorted(got) == sorted(every) and len(got) == 300
    assert sample_keys(keys, "k", 4950, "s").count() == 4950
    assert sample_keys(keys, "k", 9000, "s").count() == 5000 and sample_keys(keys.limit(0), "k", 5, "s").count() == 0


def test_many_overlapping_proposals_are_linear():
    text = " x ".join(f"{i:010d}" for i in range(20000))
    model = pii.Trees([], [], dict.fromkeys(range(4), 0.0))
    began = time.time()
    base, spans = pii.spans_of(text, model)
    assert time.time() - began < 20 and len(spans) > 1000
    added = sorted((a, b) for a, k, b in set(spans) - set(base))
    assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))


def test_loosened_keeps_what_features_see():
    text = "x" * 100 + " call card 4111 1111 1111 1111, mail me.you@example.org now 10.0.0.1"
    for span in pii.base_spans(text):
        a, kind, b = span
        short, at = pii.loosened(text, span)
        whole = text[:a] + short[at[0] : at[2]] + text[b:]
        assert pii.features(short, at) == pii.features(whole, (a, kind, a + at[2] - at[0]))


def test_quality_shrinks_sparse_sites(spark):
    marked = [("a", "x", 1)] * 300 + [("b", "x", 0)] * 300 + [("c", "x", 0)] + [("d", "x", 1)] * 100 + [(None, None, 1)] * 50
    p = {r.host: r for r in quality.posteriors(spark.createDataFrame(marked, "host string, path string, label int")).collect()}
    assert p["a"].path_posterior > 0.95 and p["b"].path_posterior < 0.05
    assert 0.05 < p["c"].path_posterior < p["c"].overall
    assert None in p


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.rate_quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.95
    odd = spark.createDataFrame([(None, None, None, None), (1, "", "s", None)], "doc_id long, text string, source string, lang string")
    assert quality.rate_quality(odd, labels).count() == 2
    assert {r.kept for r in quality.rate_quality(odd, labels.limit(0)).collect()} == {True}


def test_site_posteriors_equal_plain_version(spark):
    """Counts by host and leading segments, each document without its own outcome."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(500):
        host = str(rng.choice(["a.org", "b.org", "c.org", "d.org"], p=[0.5, 0.3, 0.15, 0.05])) if i % 40 else None
        rows.append((i, "same words here", host, f"/{rng.choice(['en', 'fr'])}/{i}" if i % 30 else None))
    labels = [(i, int(rng.random() < {"a.org": 0.9, "b.org": 0.2}.get(rows[i][2], 0.5))) for i in range(0, 500) if i % 3]
    rows += [(4, "same words here", "z.org", "/en/4"), (700, "same words here", "b.org", "/de/1"), (701, None, "new.org", "/x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")

    def level(p):
        return None if p is None else p[: p.rindex("/") + 1] if "/" in p else p

    used = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    least = {}
    for i, _, h, p in rows:
        site = (h, level(p))
        if i in used and (i not in least or ((site[0] is not None, site[0] or ""), site[1] or "") < ((least[i][0] is not None, least[i][0] or ""), least[i][1] or "")):
            least[i] = site
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for i, (h, p) in least.items():
        for c in (paths[h, p], hosts[h]):
            c[0] += 1
            c[1] += used[i]
    n, g = len(used), sum(used.values())

    def strength(groups):
        total = sum(k for k, _, _ in groups)
        noise = sum(k * c * (1 - c) for k, _, c in groups) / total
        spread = sum(k * (s / k - c) ** 2 for k, s, c in groups) / total
        share = len(groups) / total
        return min(max((noise - spread) / (spread - noise * share), quality.MIN_STRENGTH), quality.MAX_STRENGTH) if spread > noise * share else quality.MAX_STRENGTH

    kh = strength([(k, s, g / n) for k, s in hosts.values()])
    mean = {h: (s + kh * g / n) / (k + kh) for h, (k, s) in hosts.items()}
    kp = strength([(k, s, mean[h]) for (h, _), (k, s) in paths.items()])
    for r in quality.rate_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).join(df, "doc_id").select("doc_id", "site_posterior").distinct().collect():
        sites = {(h, level(p)) for i, _, h, p in rows if i == r.doc_id}
        allowed = []
        for h, p in sites:
            one = int(r.doc_id in used)
            oh = int(one and least[r.doc_id][0] == h)
            op = int(oh and least[r.doc_id][1] == p)
            y = used.get(r.doc_id, 0)
            rest = (g - y * one) / (n - one)
            if (h, p) in paths:
                of_host = (hosts[h][1] - y * oh + kh * rest) / (hosts[h][0] - oh + kh)
                allowed.append((paths[h, p][1] - y * op + kp * of_host) / (paths[h, p][0] - op + kp))
            elif h in hosts:
                allowed.append((hosts[h][1] - y * oh + kh * g / n) / (hosts[h][0] - oh + kh))
            else:
                allowed.append(g / n)
        assert min(abs(r.site_posterior - a) for a in allowed) < 1e-9, r


def test_quality_own_label_says_nothing(spark):
    """Labelled documents of one site and one text score alike, whatever their own labels."""
    ids = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame([(i, "same words here", "a.org", f"/en/{i}", "k") for i in ids], "doc_id long, text string, source string, lang string, page_doc string")
    got = quality.rate_quality(df, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")).toPandas()
    by = got.groupby(got["doc_id"] % 2)["site_posterior"].mean()
    assert abs(by[0] - by[1]) < 0.02 and by[1] <= by[0]
    pages = spark.createDataFrame([(1, "http://a.org/en/7")], "page_id long, url string")
    assert quality.sites_of_pages(df, pages).columns == df.columns


def test_quality_unlabelled_path_takes_its_host(spark):
    good = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = [(i, "same words here", "a.org" if i % 2 else "b.org", f"/en/{i}") for i in good]
    labels = [(i, i % 2) for i in good]
    docs += [(1000, "same words here", "a.org", "/en/1000"), (1001, "same words here", "b.org", "/en/1001"), (1002, "same words here", "c.org", "/en/1002")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.rate_quality(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == len(docs)
    assert got[1000].site_posterior > 0.95 and got[1001].site_posterior < 0.05 and abs(got[1002].site_posterior - 0.5) < 0.05
    assert got[1000].kept and not got[1001].kept
    pages = spark.createDataFrame([(1, "http://B.org/en/7?x"), (2, "http://a.org/en/7"), (3, "http://a.org/about"), (4, None)], "page_id long, url string")
    rows = spark.createDataFrame([(7, "t", "s", "en"), (8, "t", "s", None), (None, "t", "s", "en")], "doc_id long, text string, source string, lang string")
    assert sorted(map(tuple, quality.sites_of_pages(rows, pages).collect()), key=str) == [(7, "t", "a.org", "/en/7"), (8, "t", "s", None), (None, "t", "s", "en")]


def plain_leaks(text, items):
    ws = DC.words(text.encode())
    found, longest = set(), max((len(DC.words(t.encode())) for _, t in items), default=1)
    for s in range(0, max(1, len(ws) - longest), longest):
        p = ws[s : s + 2 * longest]
        for i, t in items:
            parts = [x for x in DC.question_and_answer(t) if x]
            shares = []
            for part in parts:
                n = min(5, len(part))
                mine = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)}
                theirs = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)}
                shares.append(100 * len(mine & theirs) >= 75 * len(mine))
            if parts and all(shares):
                found.add(i)
    return found


def test_leaks_equal_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.limit(250).collect()]
    # Partial copies on both sides of the threshold.
    for k, (_, t) in enumerate(items[:20]):
        w = t.split(" ")
        rows.append((9000 + k, "before it " + " ".join(w[: len(w) - k % 7]) + " after it"))
        w[len(w) // 2] = "changed"
        rows.append((9100 + k, " ".join(w).upper()))
    want = {(d, i) for d, t in rows for i in plain_leaks(t, items)}
    got = DC.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert len(want) > 10


def test_parts_of_the_benchmark_change_nothing(spark):
    """One pass or many: the same rows with the same scores."""
    docs, bench = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(tuple(r) for r in DC.find_leaks(docs, bench).collect())
    many = sorted(tuple(r) for r in DC.find_leaks(docs, bench, index_bytes=1500).collect())
    assert len(one) > 3 and [r[:3] + r[4:] for r in one] == [r[:3] + r[4:] for r in many]
    assert np.allclose([r[3] for r in one], [r[3] for r in many], rtol=1e-12)


def test_search_equals_scoring_everything():
    rng = np.random.default_rng(17)
    items = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.4, 25) % 400) + ".") for i in range(300)]
    index = DC.Index(items)
    for _ in range(200):
        u = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 60)))
        want = Counter()
        for k in u.tolist():
            for run in range(index.begin[k], index.begin[k + 1]):
                for at in range(index.run_begin[run], index.run_begin[run + 1]):
                    want[int(index.items[at])] += float(index.gains[at])
        want = {i: x for i, x in want.items() if x >= 1 - 1e-6}
        got = dict(index.search(u))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_leaks_odd_rows(spark):
    bench = spark.createDataFrame([(1, "what is it? blue"), (2, None), (3, ""), (3, "one"), (4, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "well WHAT is it? blue sky", "p"), (1, "well WHAT is it? blue sky", "p"), (2, None, "p"), (None, "one", "p"), (5, "x " * 50_000 + "a b c d e f g", "p")], "doc_id long, text string, item_id string")
    got = Counter((r.doc_id, r.item_id) for r in DC.find_leaks(docs, bench).collect())
    assert got == Counter({(1, 1): 2, (None, 3): 1, (5, 4): 1})
    assert [r.doc_id for r in DC.drop_leaking(docs, bench).collect()] == [2]
    assert DC.drop_leaking(docs, bench).columns == docs.columns
    assert DC.find_leaks(docs, bench.limit(0)).collect() == []
    assert DC.find_leaks(docs.limit(0), bench).collect() == []


def test_leaks_with_glued_marks(spark):
    item = "Which river runs through the old town of the north and where does it end? It ends in the grey sea."
    short = "Name the tall tree that stands behind the mill near the lake? An oak."
    bench = spark.createDataFrame([(1, item), (2, short), (3, short.replace("oak", "\u00e9rable \u00e0 sucre"))], "item_id long, text string")
    copies = [f"before {item}&&& %% after", f"before %%%{item} after", f"(\u00ab{item}\u00bb)", f"before --{short}\u2026 after", f"x \u201c{short}%%%", short.replace("oak", "\u00e9rable \u00e0 sucre").upper(), item.replace("grey", "blue"), "It ends in the grey sea.&&&"]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.question_percent, r.answer_percent) for r in DC.find_leaks(docs, bench).collect()}
    assert got == {(k, i): (100, 100) for k, i in ((0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 3))}
    assert DC.words("\u00c9t\u00e9, \u00bfqu\u00e9? A.b- &&& it's\u2026".encode()) == ["\u00e9t\u00e9".encode(), "qu\u00e9".encode(), b"a.b", b"it's"]


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    return host.translate({i: i + 32 for i in range(65, 91)}), re.match("[^?#]*", rest[len(host) :]).group()


def test_urls_and_rules(spark):
    urls = ["http://A.Example.org/es/1?x", "https://example.org", "x", None, "http://", "s://h.com/fr/a#b", "s://com/de/", "s://xcom/de/", "a://b://c/d", "http://Ä.net/é?q#r", "http://org/?/es/", "http://a.example.org/en/12", "http://h.net#/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in UR.judge(df, spark.createDataFrame([], "page_id long, good int")).collect()}
    fits = lambda h, p, rule: (h == rule[1] or h.endswith("." + rule[1])) and p.startswith(rule[2])
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path) == split_url(u)
        best = max((r for r in UR.RULES if fits(got[i].host, got[i].path, r)), key=lambda r: len(r[1] + r[2]), default=None)
        assert got[i].rule == (best and best[1] + best[2])
        assert best is None or got[i].verdict == best[0]
    assert UR.judge(df.limit(0), spark.createDataFrame([(1, 1)], "page_id long, good int")).collect() == []


def test_reputation_shrinks(spark):
    outcomes = [("a.x.net", 1)] * 400 + [("b.x.net", 0)] * 400 + [("c.y.net", 1)] * 3
    hosts = spark.createDataFrame([(h,) for h in ("a.x.net", "b.x.net", "c.y.net", "new.x.net", "new.z.com", "")], "host string")
    r = {x.host: x for x in UR.host_reputation(hosts, spark.createDataFrame(outcomes, "host string, good int")).collect()}
    assert r["a.x.net"].bound > 0.9 > 0.1 > r["b.x.net"].posterior
    assert r["c.y.net"].posterior < 1 and r["new.x.net"].bound < 0.5 and set(r) == {"a.x.net", "b.x.net", "c.y.net", "new.x.net", "new.z.com", ""}


def test_registered_domains(spark):
    hosts = {
        "news.bbc.co.uk": ("bbc.co.uk", "co.uk"), "bbc.co.uk": ("bbc.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "a.b.example.com": ("example.com", "com"),
        "example.com:8080": ("example.com", "com"), "me:pw@shop.example.com:1": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1"), "": ("", ""), "localhost": ("localhost", "localhost"), "x.org.au:": ("x.org.au", "org.au"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {tuple(r) for r in df.select(*UR._levels(F.col("host"))).collect()} == {(h, d, s) for h, (d, s) in hosts.items()}


def test_url_oracle_on_odd_hosts(spark, tmp_path):
    """Ports, users, addresses and two-label suffixes: the query equals its SQL."""
    rng = np.random.default_rng(3)
    names = ["a.co.uk", "news.b.co.uk", "b.co.uk:81", "x@b.co.uk", "10.0.0.1", "10.0.0.1:80", "c.com", "d.c.com:8080", "e.net", "f.e.net", "", "g.org.au"]
    rows = [(i, f"http://{names[int(rng.integers(0, len(names)))]}/en/{i}") for i in range(600)]
    labels = [(i, int(rng.random() < 0.9), 0) for i in range(600)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(LLM_ORACLE["op8_url_reputation"]).df()
    got = LLM_QUERIES["op8_url_reputation"](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("page_id").reset_index(drop=True).fillna(""), want[got.columns].sort_values("page_id").reset_index(drop=True).fillna(""), check_dtype=False)


@pytest.mark.parametrize("d", [SF_SMALL, SF_MID])
def test_url_oracle(spark, d):
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    want = con.execute(LLM_ORACLE["op8_url_reputation"]).df()
    got = LLM_QUERIES["op8_url_reputation"](spark, d).toPandas()
    by = ["page_id"]
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True).fillna(""), want[got.columns].sort_values(by).reset_index(drop=True).fillna(""), check_dtype=False)


def plain_lines(rows, min_docs):
    """The rule of the module, in plain Python: what each text becomes."""
    mask = lambda x: " ".join("<*>" if re.search("[0-9]", w) else w for w in re.sub(r"\s+", " ", x).strip(" ").split(" "))
    seen, leaf, where = defaultdict(set), defaultdict(set), []
    for i, t in rows:
        for at, x in enumerate((t or "").split("\n") if t is not None else []):
            m = mask(x)
            w = m.split(" ")
            if len(w) >= LT.MIN_TOKENS:
                seen[m].add(t)
                leaf[(len(w), tuple(w[: LT.LEAD]))].add(m)
                where.append((i, t, at, m))
    template = {m: m for m, ts in seen.items() if len(ts) >= min_docs}
    for key, ms in leaf.items():
        if len(ms) > 1 and sum(len(seen[m]) for m in ms) >= min_docs:
            fixed = {}
            for at in range(key[0]):
                (w, c), = Counter(m.split(" ")[at] for m in ms).most_common(1)
                if c >= LT.FIXED_SHARE * len(ms):
                    fixed[at] = w
            if LT.SIMILARITY * key[0] <= len(fixed) < key[0]:
                hit = [m for m in ms if all(m.split(" ")[a] == w for a, w in fixed.items())]
                if sum(len(seen[m]) for m in hit) >= min_docs:
                    template.update(dict.fromkeys(hit, key))
    return template, where


def test_lines_equal_plain_rule(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choice(list("abcdefghij"), rng.integers(2, 7))) for _ in range(4)]
        lines.insert(1, f"posted on 2024-{i} by user {rng.choice(['ann', 'bob'])} in the forum today")
        if i % 2:
            lines.append("all rights reserved here")
        if i % 3 == 0:
            lines.append("level info thing is  %s done well and truly ok" % rng.choice(["red", "blue", "green", "grey"]))
        rows.append((i, "\n".join(lines)))
    rows += [(200, "all rights reserved here"), (201, None), (202, ""), (203, "\n\n"), (3, rows[3][1])]
    template, where = plain_lines(rows, 10)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, at string")
    got = LT.recurring_lines(df, min_docs=10).collect()
    groups = defaultdict(set)
    for i, t, at, m in where:
        if m in template:
            groups[template[m]].add((i, t, at))
    assert any(isinstance(k, tuple) for k in groups) and any(isinstance(k, str) for k in groups)
    lost = {(r.doc_id, r.at) for r in got}
    for k, places in groups.items():
        first = min(i for i, _, _ in places)
        assert {(i, at) for i, _, at in places if i != first} <= lost, k
        assert sum((i, at) not in lost for i, _, at in places if i == first) == 1
    assert lost <= {(i, at) for p in groups.values() for i, _, at in p}
    out = LT.drop_recurring_lines(df, min_docs=10)
    assert out.columns == df.columns
    texts = Counter((r.doc_id, r.text) for r in out.collect())
    kept = lambda i, t: t if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in lost)
    assert texts == Counter((i, kept(i, t)) for i, t in rows)
    assert LT.drop_recurring_lines(df.limit(0)).collect() == []


def _words_of(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))


def test_templates_share_a_leaf(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(30):
        w = _words_of(rng, 1)
        # Two templates with one opening and length, and one among many unrelated lines.
        first = f"from the desk of {w} please call back soon" if i % 2 else f"from the desk sent {w} to all our readers"
        other = [f"it is now {_words_of(rng, 6)}" for _ in range(6)]
        rows.append((i, "\n".join([first, f"it is now time to leave {w} for good", *other])))
    got = Counter(r.at for r in LT.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {0: 28, 1: 29}


def test_count_depends_on_line_length(spark):
    rng = np.random.default_rng(10)
    passage = _words_of(rng, 60)
    rows = [(i, "\n".join([_words_of(rng, 20), "Read more" if i < 200 else _words_of(rng, 2), "", str(i), *([passage] if i in (5, 50, 250) else [])])) for i in range(300)]
    got = {(r.doc_id, r.at) for r in LT.recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 1) for i in range(1, 200)} | {(50, 4), (250, 4)}


def test_personal_data_is_learned_from_all_documents(spark, monkeypatch):
    """No choice of documents comes before the examples: other ids, the same trees and thresholds."""
    rng = np.random.default_rng(4)
    texts = []
    for i in range(400):
        n = "".join(rng.choice(list("0123456789"), 10))
        texts.append(f"call me +1 ({n[:3]}) {n[3:6]}-{n[6:]} from {n[0]}{n[1]}.{n[2]}{n[3]}.7.9 mail joe{i}@mail.example.com order {n}{n[:4]}")
    monkeypatch.setattr(pii, "sample_keys", None)
    models = [pii.fit(spark.createDataFrame([(i * k, t) for i, t in enumerate(texts, 1)], "doc_id long, text string")) for k in (1, 1009)]
    assert models[0].trees == models[1].trees and models[0].thresholds == models[1].thresholds
