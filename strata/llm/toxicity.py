"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text (present or not): words, the leading four to six
characters of longer words, pairs of neighbouring words and skip-grams (pairs
with one or two words between), hashed to DIMENSIONS weights. FTRL keeps a
learning rate for each coordinate, and its L1 term leaves most weights at zero, so the
model is a short list of (index, weight) that every task can hold.

The model is fitted on at most ``sample_rows`` labelled documents (the least
by a hash of the id, so the choice does not depend on partitioning). Ids are
chosen first, and only the chosen texts move. They are dealt into SHARDS fixed
shards by that hash; each shard trains a model in one task, and a grouped mean
of the weights joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import caches
from strata.llm.store import materialize, sample_keys, ship
from strata.llm.text import mix, word_hashes

DIMENSIONS = 1 << 21
SAMPLE_ROWS, SHARDS, EPOCHS = 12_000, 2, 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.0
THRESHOLD = 0.3
PUNCTUATION = b".,;:!?\"'()[]{}*#%&$|-_<>/\\"
CLIP = 30.0

_SKIPS = (1, 2, 3)  # distance 1: bigram; 2 and 3: skip-grams


def terms(text: bytes | None) -> list[bytes]:
    return [w for w in (w.strip(PUNCTUATION) for w in (text or b"").lower().split()) if w]


def feature_indices(text: bytes | None) -> np.ndarray:
    """Hashed indices of all features, with repetitions; empty for texts without words."""
    ws = terms(text)
    if not ws:
        return np.empty(0, dtype=np.int64)
    h = word_hashes(ws)
    parts = [h]
    for n in (4, 5, 6):
        starts = [w.decode("utf-8", "ignore")[:n].encode() for w in ws if len(w) > n]
        if starts:
            parts.append(mix(word_hashes(starts) + np.uint64(n)))
    for gap in _SKIPS:
        if len(h) > gap:
            parts.append(mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) & np.uint64(DIMENSIONS - 1)).astype(np.int64)


def train(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal over the examples in order; returns dense weights and the bias."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    zb = nb = bias = 0.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(epochs):
        for x, y in examples:
            w = weights(x)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -CLIP, CLIP)))
            g = p - y
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / ALPHA * bias
            nb += g * g
            bias = -zb * ALPHA / (BETA + np.sqrt(nb))
    return weights(np.arange(DIMENSIONS)), float(bias)


def _fit(pdf):
    import pandas as pd

    caches.enter("toxicity")
    pdf = pdf.sort_values(["order", "doc_id"])
    # Indices are below DIMENSIONS: half the memory of the whole sample.
    examples = [(np.unique(feature_indices(t.encode() if t else b"")).astype(np.int32), int(y)) for t, y in zip(pdf["text"], pdf["label"], strict=True)]
    w, bias = train(examples)
    at = np.flatnonzero(w)
    return pd.DataFrame({"feature": np.r_[at, -1], "weight": np.r_[w[at], bias]})


def fit(docs: DataFrame, marks: DataFrame, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS) -> list[tuple[int, float]]:
    """(feature, weight) of the non-zero weights, the bias at feature -1.

    ``docs``: (doc_id, text); ``marks``: one row (doc_id, label) per labelled id.
    The ids to learn from are chosen before any text is moved: at most
    ``sample_rows`` of those that have a document. Of texts under one id the
    least is taken. Each shard of ids trains its own weights; their mean is
    over the shards that have documents. Without any labelled document there is
    no weight and the bias is zero.
    """
    ship(docs.sparkSession)
    marks = marks.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = materialize(marks.join(docs.select("doc_id"), "doc_id", "left_semi"), "marks")
    chosen = sample_keys(known, "doc_id", sample_rows, "toxicity")
    # At most ``sample_rows`` rows of three numbers.
    chosen = materialize(known.join(F.broadcast(chosen), "doc_id"), "chosen")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(texts.groupBy("doc_id", "label", "order").agg(F.min("text").alias("text")), "sample")
    trained = sample.groupBy(F.pmod("order", F.lit(shards)).alias("shard")).applyInPandas(_fit, "feature long, weight double")
    # At most DIMENSIONS rows, in practice the few thousand that L1 leaves; each shard has one bias.
    sums = trained.groupBy("feature").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).collect()
    used = max((r.n for r in sums if r.feature == -1), default=1)
    return [(r.feature, r.weight / used) for r in sums]


def _arrays(model: list[tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, float]:
    w = dict(model)
    bias = w.pop(-1, 0.0)
    return np.array(sorted(w), dtype=np.int64), np.array([w[k] for k in sorted(w)], dtype=np.float64), bias


def _score(at: np.ndarray, w: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("toxicity")
        dense = np.zeros(DIMENSIONS)
        dense[at] = w
        for batch in batches:
            out = []
            for t in batch.column(1):
                x = feature_indices(t.cast(pa.binary()).as_py())
                x = np.unique(x[dense[x] != 0.0])
                out.append(1.0 / (1.0 + np.exp(-np.clip(dense[x].sum() + bias, -CLIP, CLIP))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null and empty texts score the bias alone."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_score(*_arrays(model)), "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: never trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, float]]:
    """Model from ``labels.toxic`` of the documents outside the held-out fold.

    Repeated labels of one document count as toxic if any says so; labels
    without a document, and documents without a label, are ignored.
    """
    marks = labels.filter("doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return fit(docs.select("doc_id", "text"), marks, sample_rows)


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, whatever its other columns."""
    rows = score(docs, fit_on_labels(docs, labels, sample_rows))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep(at: np.ndarray, w: np.ndarray, bias: float, text: int):
    judge = _score(at, w, bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text)], names=["doc_id", "text"])
            for scored in judge(iter([part])):
                yield batch.filter(pa.compute.less(scored.column(1), THRESHOLD))

    return run


def keep_clean(docs: DataFrame, model: list[tuple[int, float]], text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score THRESHOLD or more, in one pass; all columns stay."""
    ship(docs.sparkSession)
    return docs.mapInArrow(_keep(*_arrays(model), docs.columns.index(text_col)), docs.schema)
