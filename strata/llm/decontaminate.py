"""Benchmark decontamination: passages against a BM25 index of test items.

Test items are indexed by word, each posting with its BM25 contribution. A
training document is read in overlapping passages, twice the longest item in
length and one longest item apart, so that a copy of an item lies whole in
some passage. Each passage is a query, and block-max WAND finds every item
whose score reaches the item's threshold:

* the sum of its words' greatest contributions must reach it (WAND bound);
* then the sum of their greatest contributions within a block of items must
  reach it for that block (block-max bound);
* only their postings in such blocks are read and scored.

Contributions are divided by the item's threshold, so that all thresholds are
1. The threshold is the least score that a passage with the overlap asked for
can have: of n shingles it may miss m, so it misses at most m words, and the
m heaviest are taken off the item's own score. No hit is lost. Words that are
in more than STOP_SHARE of the items (and in more than STOP_ITEMS) are neither
indexed nor counted.

Counts and lengths are those of the whole benchmark, also where its items are
scanned in several parts, so no result depends on the parts.

Hits are verified on five-word shingles: question (all but the last sentence)
and answer (the last one; what follows the last question mark, if there is
one) must each have PERCENT of their shingles in the passage.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import caches
from strata.llm import text as T
from strata.llm.store import materialize, ship, unused
from strata.llm.text import SHINGLE_WORDS, shingle_sequence, word_hashes

PERCENT, K1, B = 75, 1.2, 0.75
STOP_SHARE, STOP_ITEMS = 0.25, 5
BLOCK = 8
# Text bytes of test items held by a task at once; more items are scanned in several passes.
INDEX_BYTES = 8 << 20
# Raw words of the documents whose terms a task remembers.
MEMO_WORDS = 200_000

_SENTENCE = re.compile(r"[.!?](?=\s+\S)|\n(?=\s*\S)")
_MARKS = string.punctuation.encode()


@lru_cache(1 << 16)
def _bare(word: bytes) -> bytes:
    """``word`` in lower case without punctuation, symbols, blanks and controls at its edges."""
    s = word.decode("utf-8", "replace").lower()
    inside = [k for k, c in enumerate(s) if unicodedata.category(c)[0] not in "PSZC"]
    return s[inside[0] : inside[-1] + 1].encode() if inside else b""


caches.remembers("decontaminate", _bare.cache_clear)


def bare(word: bytes) -> bytes:
    """``word`` (A-Z lower-cased) without the marks at its edges; empty if it is marks only."""
    w = word.strip(_MARKS)
    # Only words beyond ASCII need the Unicode categories and lower case.
    return w if w.isascii() else _bare(w)


def words(text: bytes) -> list[bytes]:
    """Lower-cased words without the marks at their edges; words of marks only are left out."""
    return [w for w in map(bare, T.words(text)) if w]


class _TermIds(dict):
    """Term of a raw word: -1 for words outside the index, -2 for marks only."""

    def __init__(self, terms: dict[bytes, int]):
        super().__init__()
        self.terms = terms

    def __missing__(self, raw: bytes) -> int:
        w = bare(raw)
        k = self.terms.get(w, -1) if w else -2
        if len(self) < MEMO_WORDS:
            self[raw] = k
        return k


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    cut = text.rfind("?") + 1
    if not cut or not text[cut:].strip():
        ends = [m.end() for m in _SENTENCE.finditer(text)]
        cut = ends[-1] if ends else len(text)
    return words(text[:cut].encode()), words(text[cut:].encode())


def _spread(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """firsts[i], firsts[i] + 1, ... counts[i] of them, one i after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(firsts - before, counts)


def _parts(text: str) -> list[np.ndarray]:
    """Distinct shingles of question and answer; a part without words is left out."""
    return [np.unique(shingle_sequence(word_hashes(p))) for p in question_and_answer(text) if p]


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: their number, mean and greatest length, and in how many each word is."""

    items: int
    mean: float
    longest: int
    holding: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Statistics:
        holding: dict[bytes, int] = {}
        for t in texts:
            for w in set(t):
                holding[w] = holding.get(w, 0) + 1
        return cls(len(texts), sum(map(len, texts)) / max(1, len(texts)), max(map(len, texts), default=1), holding)


class Index:
    """BM25 postings with list and block maxima, all divided by the items' thresholds."""

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT, statistics: Statistics | None = None):
        items = [(i, t) for i, t in items if words(t.encode())]
        self.percent = percent
        self.item_ids = [i for i, _ in items]
        self.parts = [_parts(t) for _, t in items]
        texts = [words(t.encode()) for _, t in items]
        known = statistics or Statistics.of(texts)
        self.longest, n, df = known.longest, known.items, known.holding
        stop = max(STOP_SHARE * n, STOP_ITEMS)
        self.terms = {w: k for k, w in enumerate(sorted({w for t in texts for w in t if df[w] <= stop}))}
        self.term_ids = _TermIds(self.terms)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        self.always = []  # items that their indexed words cannot rule out
        for i, t in enumerate(texts):
            gains: dict[int, float] = {}
            for w in set(t):
                if w in self.terms:
                    tf = t.count(w)
                    idf = np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                    gains[self.terms[w]] = float(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / known.mean)))
            missed = sum(len(p) - -(-percent * len(p) // 100) for p in self.parts[i])
            threshold = sum(sorted(gains.values(), reverse=True)[missed:])
            if threshold <= 0:
                self.always.append(i)
                continue
            for k, g in gains.items():
                postings[k].append((i, g / threshold))
        flat = [x for rows in postings for x in rows]
        self.items = np.array([i for i, _ in flat], dtype=np.int64)
        self.gains = np.array([g for _, g in flat], dtype=np.float64)
        # A term's postings in one block of items stand together: where they
        # begin, whose they are and their greatest gain, as sparse as the postings.
        self.blocks = -(-len(items) // BLOCK) or 1
        term = np.repeat(np.arange(len(postings)), [len(rows) for rows in postings])
        run = term * self.blocks + self.items // BLOCK
        opens = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, dtype=np.int64)
        self.run_begin = np.append(opens, len(run))
        self.run_block = run[opens] % self.blocks
        self.run_max = np.maximum.reduceat(self.gains, opens) if len(run) else np.empty(0)
        self.begin = np.searchsorted(term[opens], np.arange(len(postings) + 1))
        self.list_max = np.zeros(len(postings) + 1)
        np.maximum.at(self.list_max, term[opens], self.run_max)

    def search(self, u: np.ndarray) -> list[tuple[int, float]]:
        """(item, score over threshold) of all items that the distinct terms ``u`` lift to 1."""
        runs = _spread(self.begin[u + 1] - self.begin[u], self.begin[u])
        alive = np.bincount(self.run_block[runs], self.run_max[runs], self.blocks) >= 1 - 1e-6
        runs = runs[alive[self.run_block[runs]]]
        if not len(runs):
            return []
        at = _spread(self.run_begin[runs + 1] - self.run_begin[runs], self.run_begin[runs])
        held, which = np.unique(self.items[at], return_inverse=True)
        scores = np.bincount(which, self.gains[at])
        return [(int(i), float(x)) for i, x in zip(held, scores, strict=True) if x >= 1 - 1e-6]

    def verify(self, i: int, shingles: np.ndarray) -> list[int] | None:
        """Percent of each part's shingles in the passage, if every part has enough."""
        out = []
        for p in self.parts[i]:
            hit = int(np.isin(p, shingles).sum())
            if 100 * hit < self.percent * len(p):
                return None
            out.append(100 * hit // len(p))
        return out

    def hits(self, text: bytes) -> dict[int, tuple[float, int, int]]:
        """item -> (score, question percent, answer percent) of the document's best passage."""
        raw = T.words(text)
        ids = np.fromiter(map(self.term_ids.__getitem__, raw), dtype=np.int64, count=len(raw))
        at = np.flatnonzero(ids != -2)  # words that are not marks only
        ids = ids[at]
        size, stride = 2 * self.longest, self.longest
        starts = np.arange(0, max(1, len(ids) - stride), stride)
        total = np.r_[0.0, np.cumsum(self.list_max[ids])]
        bound = total[np.minimum(starts + size, len(ids))] - total[starts]
        out: dict[int, tuple[float, int, int]] = {}
        if not len(ids):
            return out
        for s in starts[(bound >= 1 - 1e-6) | bool(self.always)]:
            u = np.unique(ids[s : s + size])
            found = self.search(u[u >= 0]) if len(u) and u[-1] >= 0 else []
            found += [(i, 1.0) for i in self.always]
            if not found:
                continue
            shingles = self._shingles([bare(raw[k]) for k in at[s : s + size]])
            for i, score in found:
                shares = self.verify(i, shingles)
                if shares is not None:
                    out[i] = max(out.get(i, (0.0, 0, 0)), (score, shares[0], shares[-1]))
        return out

    @staticmethod
    def _shingles(ws: list[bytes]) -> np.ndarray:
        """All runs of one to five words: a part of fewer than five words is one shorter run."""
        h = word_hashes(ws)
        return np.concatenate([shingle_sequence(h, n) for n in range(1, min(SHINGLE_WORDS, len(h)) + 1)])


FOUND = "doc_id long, text_key long, item_id long, score double, question_percent int, answer_percent int"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [words(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([sorted(set(t)) for t in texts], pa.list_(pa.binary()))], names=["part", "n", "words"]
        )


def _scan(items: list[tuple[int, str]], percent: int, statistics: Statistics | None):
    index: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.enter("decontaminate")
        if not index:
            index.append(Index(items, percent, statistics))
        for batch in batches:
            rows = []
            for i, key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                t = t.as_py()
                if t:
                    for item, (score, q, a) in sorted(index[0].hits(t).items()):
                        rows.append((i, key, index[0].item_ids[item], score, q, a))
            if rows:
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "item_id", "score", "question_percent", "answer_percent"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per (document, test item) of which a passage has the overlap asked for.

    (doc_id, text_key, item_id, score, question_percent, answer_percent);
    text_key is the hash of the text, score the BM25 score over the item's
    threshold. Null or wordless texts and items have no hits; repeated
    documents and items are each reported. Items beyond ``index_bytes`` of text
    are scanned in further passes over the documents, so a task (and the driver)
    never holds more than that; the rows are the same.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 + int(size) // index_bytes
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    counted = _statistics(dealt) if passes > 1 else None
    out = None
    for k in range(passes):
        part = dealt.filter(F.col("part") == k).orderBy("item_id", "text")
        found = docs.mapInArrow(_scan([(r.item_id, r.text) for r in part.collect()], percent, counted(k) if counted else None), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def _statistics(dealt: DataFrame) -> Callable[[int], Statistics]:
    """Statistics of all items, for each part with the counts of its own words."""
    held = materialize(dealt.select("part", "text").mapInArrow(_count_words, "part long, n long, words array<binary>").filter("n > 0"), "items")
    row = held.agg(F.count("*").alias("items"), F.sum("n").alias("n"), F.max("n").alias("longest")).first()
    each = held.select("part", F.explode("words").alias("word"))
    holding = materialize(each.groupBy("word").agg(F.count("*").alias("holding")), "holding")

    def of(part: int) -> Statistics:
        own = each.filter(F.col("part") == part).select("word").distinct().join(holding, "word")
        return Statistics(row["items"], (row["n"] or 0) / max(1, row["items"]), row["longest"] or 1, {bytes(r["word"]): r["holding"] for r in own.collect()})

    return of


def drop_leaking(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows and columns otherwise as they are.

    Rows that repeat an id and a text go or stay together; null and empty texts
    and rows with a null id are judged like others and stay unless they hold an
    item; an empty table stays empty.
    """
    own, key = (unused(c, docs) for c in ("leak_id", "leak_key"))
    leaks = materialize(find_leaks(docs, benchmark, percent).select(F.col("doc_id").alias(own), F.col("text_key").alias(key)).distinct(), "leaks")
    on = docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(key))
    return docs.join(leaks, on, "left_anti")
