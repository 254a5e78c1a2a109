"""Personal data: base patterns, and candidates chosen by boosted trees.

Base spans follow fixed patterns and checks and always stay. Generators with
high recall propose more, overlapping, spans: loosely written addresses,
numbers without their usual prefix or with other separators. Boosted trees
score each proposal by its format and its context. They learn from the base
spans of all documents: a proposal that is a base span of its
kind is a positive (once as written, once in a looser form), one whose checks
fail is a negative. Equal examples are one, weighing as many as they are. On
the half of them that the trees did not see a threshold per kind is
set to the least score at which PRECISION of the proposals are right. Spans
over it are added unless they touch a span already taken.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.store import materialize, sample_keys, ship

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, PRECISION = 8, 3, 0.98
# Partitions of the counted examples; the order of their sums is the same for any input's.
EXAMPLE_PARTITIONS = 16
# Characters before a span that its features see.
CONTEXT = 30
MIN_EXAMPLES = 20  # of each class, else only base spans are reported

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their ``@``: linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_ips(text: str) -> list[tuple[int, int]]:
    """Every four joined parts of a run of digits and dots, left to right; parts over 255 drop the match."""
    out = []
    for run in _DOTTED.finditer(text):
        s = run.group()
        if s.count(".") < 3:
            continue
        at, chain = run.start(), []
        for part in [*s.split("."), ""]:
            if part:
                chain.append((at, at + len(part)))
                if len(chain) == 4:
                    if all(e - b < 4 or not text[b : e - 3].strip("0") for b, e in chain) and all(int(text[max(b, e - 3) : e]) <= 255 for b, e in chain):
                        out.append((chain[0][0], chain[3][1]))
                    chain = []
            else:
                chain = []
            at += len(part) + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted: the spans of the base patterns that pass their checks."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in base_emails(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in base_ips(text)]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _NOT_DIGIT.sub("", m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Generators. All quantifiers are bounded, so proposals take linear time.
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_LOOSE_LEFT = re.compile(r"[\w.%+-]{1,64}\s?\Z")
_LOOSE_RIGHT = re.compile(r"(?:@|[(\[]at[)\]])\s?[\w-]{1,63}(?:\s?(?:\.|[(\[]dot[)\]])\s?[\w-]{1,63}){1,6}", re.I)
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().:/-]{0,2}[0-9]){6,22}")
_QUAD = re.compile(r"[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}")
_IPV6 = re.compile(r"(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}")
_HINTS = (
    re.compile("mail|contact|write|@"),
    re.compile(r"\bip\b|host|server|address|addr"),
    re.compile("card|visa|credit|pay|account|iban"),
    re.compile("tel|phone|call|fax|mobile|cell"),
)
_OTHER = re.compile("version|token|key|order|ref|id|isbn|serial|hash|password")


def proposals(text: str) -> list[tuple[int, int, int]]:
    out = set()
    if "@" in text or "at)" in text.lower() or "at]" in text.lower():
        for m in _AT.finditer(text):
            left = _LOOSE_LEFT.search(text, max(0, m.start() - 66), m.start())
            right = _LOOSE_RIGHT.match(text, m.start())
            if left and right:
                out.add((left.start(), 0, right.end()))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_NOT_DIGIT.sub("", m.group()))
            if 13 <= n <= 19:
                out.add((m.start(), 2, m.end()))
            if 7 <= n <= 15:
                out.add((m.start(), 3, m.end()))
        out.update((m.start(), 1, m.end()) for m in _QUAD.finditer(text))
        if text.count(":") > 3:
            out.update((m.start(), 1, m.end()) for m in _IPV6.finditer(text))
    return sorted(out)


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalnum() else 2.0


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    a, kind, b = span
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    parts = s.replace(" ", "").split(".")
    before = text[max(0, a - CONTEXT) : a].lower()
    seps = re.sub(r"\w", "", s)
    return [
        float(kind), float(len(digits)), float(len(s)), float(len(seps)), float(len(set(seps))), float("+" in s), float("(" in s),
        float(bool(digits) and luhn(digits)), float(len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)),
        _side(text[a - 1 : a]), _side(text[b : b + 1]), float(sum(c.isalpha() for c in s)), float(bool(_HINTS[kind].search(before))),
        float(bool(_OTHER.search(before))), float(groups[0]), float(groups[-1]), float(max(groups)), float(len(groups)),
    ]


def loosened(text: str, span: tuple[int, int, int]) -> tuple[str, tuple[int, int, int]]:
    """The same datum in a form that the base pattern does not know, with what ``features`` sees around it."""
    a, kind, b = span
    s = text[a:b]
    if kind == 0:
        s = s.replace("@", " (at) ")
    elif kind == 2:
        d = _NOT_DIGIT.sub("", s)
        s = "/".join(d[i : i + 4] for i in range(0, len(d), 4))
    elif kind == 3:
        s = s.lstrip("+")
    else:
        s = s.replace(".", " . ")
    left = text[max(0, a - CONTEXT) : a]
    return left + s + text[b : b + 1], (len(left), kind, len(left) + len(s))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, labels, xs = [], [], []
        for t in batch.column(1).to_pylist():
            base = set(base_spans(t or ""))
            for span in proposals(t or ""):
                hit = span in base
                kinds.append(span[1])
                labels.append(float(hit))
                xs.append(features(t, span))
                if hit:
                    kinds.append(span[1])
                    labels.append(1.0)
                    xs.append(features(*loosened(t, span)))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(labels, pa.float64()), pa.array(xs, pa.list_(pa.float64()))], names=["kind", "label", "x"])


class Trees:
    """Boosted trees as plain arrays: (feature, threshold, left, right, value) per tree."""

    def __init__(self, trees: list[list[tuple]], weights: list[float], thresholds: dict[int, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, x: list[float]) -> float:
        margin = 0.0
        for tree, w in zip(self.trees, self.weights, strict=True):
            at = 0
            while tree[at][0] >= 0:
                f, threshold, left, right, _ = tree[at]
                at = left if x[f] <= threshold else right
            margin += w * tree[at][4]
        return float(1.0 / (1.0 + np.exp(-2.0 * margin)))


def _flatten(node, out: list[tuple]) -> int:
    at = len(out)
    out.append(())
    if node.subtreeDepth() == 0:
        out[at] = (-1, 0.0, -1, -1, node.prediction())
    else:
        split = node.split()
        left = _flatten(node.leftChild(), out)
        right = _flatten(node.rightChild(), out)
        out[at] = (split.featureIndex(), split.threshold(), left, right, 0.0)
    return at


def _rated(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x) for x in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("label"), batch.column("n"), pa.array(scores, pa.float64())], names=["kind", "label", "n", "score"])

    return run


def fit(docs: DataFrame, sample_docs: int | None = None) -> Trees | None:
    """Trees and thresholds from all documents that hold a digit or ``@``, or from at most ``sample_docs``, if given.

    Of a sample, ids are chosen first, the least by a hash, and only the chosen texts move. None if there are fewer
    than MIN_EXAMPLES positives or negatives: then only base spans are found.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    texts = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    if sample_docs is not None:
        chosen = sample_keys(texts, "doc_id", sample_docs, "pii").select("doc_id")
        # At most ``sample_docs`` rows of a number; of texts under one id the least is taken.
        texts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(_examples, "kind int, label double, x array<double>")
    counted = found.groupBy("kind", "label", "x").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counted = counted.repartition(EXAMPLE_PARTITIONS, "x").sortWithinPartitions("kind", "label", "x")
    examples = materialize(counted.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(2))), "examples")
    classes = {r.label: r for r in examples.filter("fold = 0").groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    if min(classes[label].n if label in classes else 0 for label in (0.0, 1.0)) < MIN_EXAMPLES:
        return None
    # Spark chooses candidate cuts from maxBins ** 2 rows: with this many, from all of them.
    bins = max(32, math.isqrt(sum(r.rows for r in classes.values())) + 1)
    ready = examples.filter("fold = 0").select(array_to_vector("x").alias("features"), "label", "n")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=7, weightCol="n").fit(ready)
    trees = []
    for tree in model.trees:
        out: list[tuple] = []
        _flatten(tree._call_java("rootNode"), out)
        trees.append(out)
    scored = Trees(trees, list(model.treeWeights), dict.fromkeys(range(len(KINDS)), 2.0))  # above every score: nothing is added
    held = examples.filter("fold = 1").select("kind", "label", "n", "x").mapInArrow(_rated(scored), "kind int, label double, n double, score double")
    # A row per kind and score; scores are sums of one leaf per tree.
    marked = held.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).filter("score >= 0.5").collect()
    for kind in range(len(KINDS)):
        n = right = 0.0
        for r in sorted((r for r in marked if r.kind == kind), key=lambda r: -r.score):
            n, right = n + r.n, right + r.right
            if right >= PRECISION * n:
                scored.thresholds[kind] = r.score
    return scored


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def spans_of(text: str, model: Trees | None) -> tuple[list, list]:
    """(base spans, all spans) of one text, each sorted by start, then kind."""
    base = base_spans(text)
    if model is None:
        return base, base
    known, more = set(base), []
    taken: list[tuple[int, int]] = []  # sorted, apart from each other
    for a, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    rated = [(model.score(features(text, s)), s) for s in proposals(text) if s not in known]
    for p, (a, k, b) in sorted(rated, key=lambda r: (-r[0], r[1])):
        if p < model.thresholds[k]:
            continue
        at = bisect_left(taken, (b,))  # the spans before it begin before b
        if at == 0 or taken[at - 1][1] <= a:
            taken.insert(at, (a, b))
            more.append((a, k, b))
    return base, sorted(base + more)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _find(model: Trees | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for t in batch.column(1):
                base, all_ = spans_of(t.as_py() or "", model)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                spans.append(_join(all_))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int | None = None) -> DataFrame:
    """One row per input row: counts and digest of base spans, and all spans.

    Positions count code points, ends are exclusive; null texts are empty.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_find(fit(rows, sample_docs)), FOUND)


def redact(text: str, spans: str) -> str:
    """``text`` with every span of a ``spans`` string replaced by ``[kind]``, overlaps as one."""
    out, end = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        if int(a) >= end:
            out += [text[end : int(a)], f"[{kind}]"]
        end = max(end, int(b))
    return "".join(out) + text[end:]
