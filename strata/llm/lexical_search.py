"""Ranked lexical search by presence masks.

One pass over the texts keeps, per document, its number of terms and how often
it holds each term of the items (an inverted index by block, written once).
Document counts and lengths are aggregated over all of it.

Ranking takes a block of documents at a time. Each term of the block has a
bitmap of its documents; the bitmaps of an item's terms, read crosswise, give
every document the mask of the terms it holds. Documents with one mask form a
group, and the group cannot score more than the best occurrence in the block of
each term it holds. Groups are scored from the highest such maximum down, and a
block is finished for the item when the next maximum is below the item's k-th
score so far. No document is left out unseen: what is skipped cannot enter.

Items come in blocks of bounded text size, each with the statistics of all
documents, so the result doesn't depend on how many blocks there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.store import materialize, ship

K = 10
# Text bytes of the items ranked in one pass; they and their terms are held by every task.
ITEM_BYTES = 16 << 20
# Documents ranked together, and how many counted terms they may hold.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 4_000_000
# Parts of an item's list that are merged side by side before the last merge.
MERGE_PARTS = 32

POSTINGS = "doc_id long, n long, terms array<int>, times array<int>"

# Letters and digits of ASCII (A-Z lower-cased) and all bytes above it belong to terms.
_FOLD = bytes(
    b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; A-Z lower-cased."""
    return (text or b"").translate(_FOLD).split()


def _postings(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(vocabulary))
        look = vocabulary.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                lengths, held, counts = [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    words = terms_of(text)
                    lengths.append(len(words))
                    known = [i for i in map(look, words) if i is not None]
                    counts.append(len(known))
                    held.extend(known)
                doc = np.repeat(np.arange(len(lengths), dtype=np.int64), counts)
                keys, times = np.unique(doc * size + np.array(held, dtype=np.int64), return_counts=True)
                of, term = np.divmod(keys, size)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lengths)))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, lengths, offsets, terms, times) of at most BLOCK_DOCS documents."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK_DOCS)
            offsets = part.column("terms").offsets.to_numpy().astype(np.int64)
            fit = max(1, int(np.searchsorted(offsets, offsets[0] + BLOCK_POSTINGS, "right")) - 1)
            part, offsets = part.slice(0, fit), offsets[: min(fit, part.num_rows) + 1]
            terms, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
            ids, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "n"))
            yield ids, n, offsets - offsets[0], terms, times
            at += part.num_rows


def damping(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of each document: 25 + 75 * n * docs div total, in whole numbers."""
    if int(n.max(initial=0)) * 75 * docs < 1 << 62:
        return 25 + n * 75 * docs // total
    return np.array([25 + 75 * x * docs // total for x in n.tolist()], dtype=np.int64)


class Block:
    """Documents with their counted terms, bitmaps and best occurrences."""

    def __init__(self, ids, n, offsets, terms, times, docs: int, total: int, vocabulary: int):
        self.ids, self.offsets, self.terms, self.docs = ids, offsets, terms, len(ids)
        doc = np.repeat(np.arange(len(ids)), np.diff(offsets))
        self.impact = 1_000_000_000 * times // (1000 * times + 8 * damping(n, docs, total)[doc])
        order = np.argsort(terms, kind="stable")
        present, first, counts = np.unique(terms[order], return_index=True, return_counts=True)
        self.top = np.maximum.reduceat(self.impact[order], first) if len(first) else first
        self.row = np.full(vocabulary, -1, dtype=np.int64)
        self.row[present] = np.arange(len(present))
        width = -(-len(ids) // 8)
        bitmaps = np.zeros(len(present) * width, dtype=np.uint8)
        by_term = doc[order]
        np.bitwise_or.at(bitmaps, np.repeat(np.arange(len(present)), counts) * width + (by_term >> 3), (128 >> (by_term & 7)).astype(np.uint8))
        self.bitmaps = bitmaps.reshape(len(present), width)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks of the terms in ``rows`` (as columns of bits), documents by mask, and where each begins."""
        bits = np.unpackbits(self.bitmaps[rows], axis=1, count=self.docs)
        packed = np.packbits(bits, axis=0)
        wide = np.zeros((self.docs, -(-len(packed) // 8) * 8), dtype=np.uint8)
        wide[:, : len(packed)] = packed.T
        keys = wide.view(np.uint64)
        order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T)
        held = keys[order]
        opens = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]).any(axis=1)]))
        return bits[:, order[opens]], order, np.append(opens, self.docs)

    def scores(self, chosen: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact scores of the chosen documents; ``value``: weight by term."""
        counts = self.offsets[chosen + 1] - self.offsets[chosen]
        before = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(self.offsets[chosen] - before, counts)
        sums = np.concatenate([[0], np.cumsum(value[self.terms[at]] * self.impact[at])])
        return sums[before + counts] - sums[before]


def improve(block: Block, terms: np.ndarray, weights: np.ndarray, value: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) after ``block``; ``best`` holds them so far."""
    at = block.row[terms]
    rows, most = at[at >= 0], weights[at >= 0]
    if not len(rows):
        return best
    most = most * block.top[rows]
    floor = best[0][-1] if len(best[0]) == k else 1
    if most.sum() < floor:
        return best
    bits, order, begin = block.masks(rows)
    highest = most @ bits
    by_height = np.argsort(-highest, kind="stable")
    # Groups are scored a few at a time, more as they go on.
    done, step = 0, 8
    while done < len(by_height) and highest[by_height[done]] >= floor:
        some = by_height[done : done + step]
        some = some[highest[some] >= floor]
        sizes = begin[some + 1] - begin[some]
        before = np.cumsum(sizes) - sizes
        docs = order[np.arange(int(sizes.sum())) + np.repeat(begin[some] - before, sizes)]
        found = block.scores(docs, value)
        good = found >= floor
        scores, ids = np.concatenate([best[0], found[good]]), np.concatenate([best[1], block.ids[docs[good]]])
        keep = np.lexsort((ids, -scores))[:k]
        best = scores[keep], ids[keep]
        floor = best[0][-1] if len(keep) == k else 1
        done, step = done + step, step * 2
    return best


def _rank(items: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: int, docs: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.empty(0, dtype=np.int64)
        best = [(nothing, nothing)] * len(items)
        value = np.zeros(vocabulary, dtype=np.int64)
        for parts in _blocks(batches):
            block = Block(*parts, docs, total, vocabulary)
            for i, (_, terms, weights) in enumerate(items):
                value[terms] = weights
                best[i] = improve(block, terms, weights, value, best[i], k)
                value[terms] = 0
        sizes = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([i for i, _, _ in items], dtype=np.int64), sizes)),
                pa.array(np.concatenate([nothing, *[b[1] for b in best]])),
                pa.array(np.concatenate([nothing, *[b[0] for b in best]])),
            ],
            names=["item_id", "doc_id", "score"],
        )

    return run


def _items_of(rows: list[tuple[int, bytes]]) -> tuple[list[tuple[int, Counter]], dict[bytes, int]]:
    """Terms with repeats by item, and a number for each term."""
    of: dict[int, Counter] = {}
    for item, text in rows:
        of.setdefault(item, Counter()).update(terms_of(text))
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in of.values() for t in c}))}
    return sorted(of.items()), vocabulary


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item.

    Only scores above 0 count; equal scores by ascending doc_id. Null and empty
    texts have no terms. Repeated documents are documents of their own;
    documents with a null id count in the statistics and are never returned.
    Equal rows of ``items`` are one; different texts under one id are one item
    with the terms of all of them; a null item id is ignored. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    asked = materialize(asked.filter("item_id is not null and text is not null").distinct(), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // item_bytes))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
    found = [_search_part(rows, dealt.filter(F.col("part") == p), k) for p in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    # Every task has k rows of an item at most; they are merged in two steps.
    best = [F.col("score").desc(), F.col("doc_id")]
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*best))).filter(F.col("rank") <= k)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def _search_part(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    # At most about ITEM_BYTES of text.
    items, vocabulary = _items_of([(r.item_id, r.text.encode()) for r in asked.select("item_id", "text").collect()])
    index = materialize(rows.mapInArrow(_postings(vocabulary), POSTINGS), "postings")
    counts = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    docs, total = counts.docs, counts.total
    df = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
    # One row per term of the items.
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)
    packed = []
    for item, held in items:
        terms = np.array(sorted(t for w in held if df[t := vocabulary[w]]), dtype=np.int64)
        times = {vocabulary[w]: n for w, n in held.items()}
        packed.append((item, terms, weight[terms] * np.array([times[t] for t in terms.tolist()], dtype=np.int64)))
    schema = "item_id long, doc_id long, score long"
    return index.filter("doc_id is not null and size(terms) > 0").mapInArrow(_rank(packed, len(df), docs, max(1, total), k), schema)
