"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizers cut the same bytes (a space and the text), A by a byte-level
vocabulary, B by a piece vocabulary that writes a space as U+2581. All tokens of
both sides are sorted by their first byte, the running maximum of their ends is
taken, and a group breaks where a start reaches it: there both sides end a
token. Inside a group every A token is linked with every B token.

Neither side merges across a single space between two non-space characters, so
texts are cut there and equal chunks are aligned once, many new ones in one
call. One row per document with its distinct id pairs is written; Spark counts
the documents of each pair over the corpus and joins the counts back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import caches
from strata.llm.store import materialize, ship

# Chunks a worker remembers; it starts anew beyond them. Longer chunks are not kept.
MEMO_CHUNKS, MEMO_CHUNK_CHARS = 400_000, 40
# Documents aligned together, and text bytes after which fewer are.
BATCH_DOCS, BATCH_BYTES = 1000, 8 << 20
# Rows (pair, count, best) up to which the pair table is broadcast: 17 bytes each, 34 MB.
BROADCAST_PAIRS = 2_000_000

INDEX_SCHEMA = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links array<struct<pair: long, times: long>>"
)

_CUT = re.compile(r"(?<=\S) (?=\S)")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible bytes stand for
    themselves, the others follow from code point 256 on in byte order."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def coalesce(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Group number of each interval: groups break where a start reaches the running maximum of the ends."""
    order = np.lexsort((ends, starts))
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    breaks = np.ones(len(s), dtype=np.int64)
    breaks[1:] = s[1:] >= reach[:-1]
    groups = np.empty(len(s), dtype=np.int64)
    groups[order] = np.cumsum(breaks) - 1
    return groups


def spread(counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """firsts[i], firsts[i] + 1, ... counts[i] of them, one i after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(firsts - before, counts)


class _Column:
    """An array that grows at its end."""

    def __init__(self):
        self.data, self.size = np.zeros(1024, dtype=np.int64), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, 2 * len(self.data)) - len(self.data), dtype=np.int64)])
        self.data[self.size : need] = values
        self.size = need


class Aligner:
    """Aligned chunks of one worker: counts, id pairs and the written groups of each."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        a_pieces = {i: bytes(alphabet[c] for c in p) for p, i in self.a.get_vocab().items() if all(c in alphabet for c in p)}
        self.a_bytes = [a_pieces.get(i, b"") for i in range(max(a_pieces, default=-1) + 1)]
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.written: list[str | None] = []  # None: the bytes of a side differ from the chunk's
        self.n_a, self.n_b, self.n_groups, self.n_links, self.first, self.pairs = (_Column() for _ in range(6))
        self.local: dict[int, int] = {}
        self.codes = _Column()

    def add(self, chunks: list[str]) -> list[int]:
        """Align new chunks (each stands after a space); their numbers."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]
        ids_b = self.b.encode(chunks, num_threads=1)
        ok = []
        for c, x, y in zip(chunks, ids_a, ids_b, strict=True):
            own = b" " + c.encode()
            ok.append(b"".join([self.a_bytes[i] for i in x]) == own and b"".join([self.b_bytes[i] for i in y]) == own)
        use_a, use_b = ([x if fine else [] for x, fine in zip(ids, ok, strict=True)] for ids in (ids_a, ids_b))
        count_a, count_b = (np.array([len(x) for x in use], dtype=np.int64) for use in (use_a, use_b))
        flat_a, flat_b = (np.array([i for x in use for i in x], dtype=np.int64) for use in (use_a, use_b))
        # The tokens of both sides tile the same bytes, chunk after chunk.
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        starts = np.concatenate([end_a - self.a_size[flat_a], end_b - self.b_size[flat_b]])
        groups = coalesce(starts, np.concatenate([end_a, end_b]))
        group_a, group_b = groups[: len(flat_a)], groups[len(flat_a) :]
        n = int(groups.max()) + 1 if len(groups) else 0
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        per_a = in_b[group_a]
        linked_b = flat_b[spread(per_a, (np.cumsum(in_b) - in_b)[group_a])]
        codes = (np.repeat(flat_a, per_a) << 32) | linked_b
        distinct, which = np.unique(codes, return_inverse=True)
        numbers = np.empty(len(distinct), dtype=np.int64)
        fresh = []
        for at, code in enumerate(distinct.tolist()):
            number = self.local.get(code)
            if number is None:
                number = self.local[code] = len(self.local)
                fresh.append(code)
            numbers[at] = number
        self.codes.extend(np.array(fresh, dtype=np.int64))

        def per_chunk(of_token: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(of_token)])
            stop = np.cumsum(count_a)
            return total[stop] - total[stop - count_a]

        links = per_chunk(per_a)
        opens = np.ones(len(group_a), dtype=np.int64)
        opens[1:] = group_a[1:] != group_a[:-1]
        n_groups = per_chunk(opens)
        at = len(self.written)
        self.first.extend(self.pairs.size + np.cumsum(links) - links)
        self.pairs.extend(numbers[which])
        for column, values in ((self.n_a, count_a), (self.n_b, count_b), (self.n_groups, n_groups), (self.n_links, links)):
            column.extend(values)
        text_a, text_b = (list(map(str, x.tolist())) for x in (flat_a, flat_b))
        to_a, to_b = np.cumsum(in_a).tolist(), np.cumsum(in_b).tolist()
        pieces, i, j = [], 0, 0
        for p, q in zip(to_a, to_b, strict=True):
            pieces.append(f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}")
            i, j = p, q
        upto = 0
        for fine, g in zip(ok, n_groups.tolist(), strict=True):
            self.written.append(";".join(pieces[upto : upto + g]) if fine else None)
            upto += g
        return list(range(at, len(self.written)))

    def chunks(self, text: str) -> list[str]:
        """The text cut before single spaces between non-space characters."""
        if "  " in text or text[0].isspace() or text[-1].isspace():
            return _CUT.split(text)
        parts = text.split(" ")
        # Only what has neither side on white space is remembered.
        if any(c[0].isspace() or c[-1].isspace() for c in parts if c not in self.known):
            return _CUT.split(text)
        return parts

    def align(self, texts: list[str | None]) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Counts by name, digests, and per document (number of pairs; pair codes and times, flat)."""
        if len(self.known) > MEMO_CHUNKS:
            self.forget()
        cut = [self.chunks(t) if t else [] for t in texts]
        missing = list(dict.fromkeys(c for parts in cut for c in parts if c not in self.known))
        at = dict(zip(missing, self.add(missing), strict=True)) if missing else {}
        known = self.known
        for c, number in at.items():
            if len(c) <= MEMO_CHUNK_CHARS and not c[0].isspace() and not c[-1].isspace():
                known[c] = number
        digests, numbers = [], []
        for parts in cut:
            own = [at[c] if c in at else known[c] for c in parts]
            written = [self.written[i] for i in own]
            if not own or None in written:
                own, digest = [], ""
            else:
                digest = hashlib.sha256(";".join(written).encode()).hexdigest()
            numbers.append(own)
            digests.append(digest)
        sizes = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = np.array([i for x in numbers for i in x], dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        sums = {
            name: np.bincount(doc, column.data[flat], len(texts)).astype(np.int64)
            for name, column in (("n_a", self.n_a), ("n_b", self.n_b), ("n_groups", self.n_groups), ("n_links", self.n_links))
        }
        links = self.n_links.data[flat]
        keys = np.repeat(doc, links) * max(1, self.codes.size) + self.pairs.data[spread(links, self.first.data[flat])]
        keys, times = np.unique(keys, return_counts=True)
        of, pair = np.divmod(keys, max(1, self.codes.size))
        return sums, digests, np.bincount(of, minlength=len(texts)), self.codes.data[pair], times


_aligners: dict[tuple[str, str], Aligner] = {}


def _forget() -> None:
    for a in _aligners.values():
        a.forget()


caches.remembers("alignment", _forget)


def _index(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        caches.enter("alignment")
        if (a_path, b_path) not in _aligners:
            _aligners[a_path, b_path] = Aligner(a_path, b_path)
        aligner = _aligners[a_path, b_path]
        # The same number on a retry; numbers of different tasks never meet.
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BATCH_DOCS)
                held = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).to_numpy(zero_copy_only=False))
                part = part.slice(0, max(1, int(np.searchsorted(held, BATCH_BYTES, "right"))))
                sums, digests, per_doc, codes, times = aligner.align(part.column(1).to_pylist())
                links = pa.StructArray.from_arrays([pa.array(codes, pa.int64()), pa.array(times, pa.int64())], names=["pair", "times"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_doc)]), pa.int32())
                columns = {
                    "row": pa.array(np.arange(row, row + part.num_rows), pa.int64()),
                    "doc_id": part.column(0),
                    **{name: pa.array(x, pa.int64()) for name, x in sums.items()},
                    "groups_sha256": pa.array(digests, pa.string()),
                    "links": pa.ListArray.from_arrays(offsets, links),
                }
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                row += part.num_rows
                at += part.num_rows

    return run


def align_corpus(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(aligned documents, pairs): one row per input row as in INDEX_SCHEMA, and
    (pair, a, b, n_docs, best) for every linked id pair of the corpus.

    ``pair`` is a * 2**32 + b; ``n_docs`` counts the rows that hold it; ``best``
    marks the pairs with the highest count of their A id, ties included. Null
    and empty texts, and texts that a side does not give back byte by byte
    (U+2581 in B), have no tokens: zeros, '' and no links.
    """
    ship(docs.sparkSession)
    a_default, b_default = default_paths()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = materialize(rows.mapInArrow(_index(a_path or a_default, b_path or b_default), INDEX_SCHEMA), "aligned")
    counted = materialize(index.select(F.inline("links")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pairs")
    counted = counted.withColumn("a", F.shiftright("pair", 32)).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    # One row per id of A.
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    pairs = counted.join(most, "a").select("pair", "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    return index, materialize(pairs, "pairs")


def align_documents(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per input row.

    Repeated rows are rows of their own and each counts as a document; rows
    with a null id are kept. Other columns are ignored, whatever their names;
    an empty table gives no rows. Very long texts are aligned whole.
    """
    index, pairs = align_corpus(docs, a_path, b_path, id_col, text_col)
    counts = pairs.select("pair", "n_docs", "best")
    # Beyond the bound the planner shuffles by pair and splits frequent ones.
    side = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    valued = index.select("row", F.inline("links")).join(side, "pair")
    sums = valued.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("n_docs")).cast("long").alias("count_sum"),
    )
    none = F.lit(0).cast("long")
    joined = index.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row", "left")
    return joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )
