"""Token-id files with Elias-Fano document boundaries.

One file per shard, documents in ascending doc_id order:

    magic "TOKEF1\\0\\0" | ids, 2 or 4 bytes each | section ... section | footer

Two sections are Elias-Fano sequences: the end offset of each document in the
shard's id array, and the document ids less the least one. A sequence of n
values up to u takes n * (2 + log2(u / n)) bits and select(i) reads one of
them without decoding the rest. The footer is JSON, its length the last eight
bytes. Documents with a null id stand first and only their number is stored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.store import materialize, shared_path, ship
from strata.llm.tokens import default_path, encoder

MAGIC = b"TOKEF1\0\0"
SAMPLE = 256  # every 256th set bit of the high part has its position stored
SHARD_BYTES = 24 << 20  # text bytes a shard is meant to hold
READ_IDS = 1 << 20  # ids read from a file at once
READ_DOCS = 1 << 12  # document boundaries selected at once


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        if n == 0:
            return cls(0, 0, b"", b"", np.empty(0, np.int64))
        low_bits = max(0, int(v[-1]) // n).bit_length()
        low_bits = max(0, low_bits - 1)
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
        high[ones] = 1
        if low_bits:
            bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        else:
            low = b""
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE])

    def select(self, i: int) -> int:
        """Value number ``i``: a stored sample, then a scan of at most SAMPLE set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return (position - i) << self.low_bits | (chunk >> first % 8) & ((1 << self.low_bits) - 1)

    def block(self, first: int, count: int) -> np.ndarray:
        """Values ``first`` to ``first + count - 1``: the bits between two stored samples, no others."""
        count = max(0, min(count, self.n - first))
        if count == 0:
            return np.empty(0, np.uint64)
        sample = first // SAMPLE
        begin = int(self.samples[sample]) // 8
        after = (first + count - 1) // SAMPLE + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, end - begin, begin), bitorder="little")) + 8 * begin
        # Bits of the first byte that belong to values before the sample.
        ones = ones[np.searchsorted(ones, self.samples[sample]) :]
        index = np.arange(first, first + count)
        out = (ones[first - sample * SAMPLE :][:count] - index).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            from_bit, bits = first * self.low_bits, count * self.low_bits
            held = np.frombuffer(self.low, np.uint8, (from_bit + bits + 7) // 8 - from_bit // 8, from_bit // 8)
            held = np.unpackbits(held, bitorder="little")[from_bit % 8 :][:bits]
            weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
            out += (held.reshape(count, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
        return out

    def all(self) -> np.ndarray:
        return self.block(0, self.n)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.astype("<i8").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> EliasFano:
        n, low_bits, nl, nh, ns = struct.unpack_from("<QQQQQ", b)
        return cls(n, low_bits, b[40 : 40 + nl], b[40 + nl : 40 + nl + nh], np.frombuffer(b, "<i8", ns, 40 + nl + nh))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class TokenFile:
    """Reader of one file: boundaries by select, ids by range."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        length = struct.unpack("<Q", self.file.read_at(8, size - 8))[0]
        self.meta = json.loads(self.file.read_at(length, size - 8 - length))
        self.dtype = np.dtype(self.meta["dtype"])
        self.ends, self.ids_of_docs = (EliasFano.from_bytes(self.file.read_at(n, at)) for at, n in self.meta["sections"])

    def __len__(self) -> int:
        return self.meta["documents"]

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.meta["nulls"] else self.meta["least"] + self.ids_of_docs.select(i - self.meta["nulls"])

    def read(self, start: int, end: int) -> np.ndarray:
        w = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((end - start) * w, len(MAGIC) + start * w), dtype=self.dtype)

    def close(self) -> None:
        self.file.close()


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        dtype = "<u2" if max(enc.vocabulary, end_id + 1) <= 1 << 16 else "<u4"
        end = np.array([end_id], dtype=dtype).tobytes()
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        shard = TaskContext.get().partitionId()
        # A name of its own for each attempt, then an atomic rename: retries and
        # speculative copies of the task cannot mix their bytes.
        final = f"{path}/shard-{shard:06d}.tok"
        attempt = f"{path}/.attempt-{uuid.uuid4().hex}"
        ends, ids, total, nulls = [], [], 0, 0
        with files.open_output_stream(attempt) as out:
            out.write(MAGIC)
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = np.frombuffer(enc.encode(text.as_py()), dtype="<u4").astype(dtype).tobytes() + end
                    out.write(raw)
                    total += len(raw) // len(end)
                    ends.append(total)
                    if i is None:
                        nulls += 1
                    else:
                        ids.append(i)
            least = ids[0] if ids else 0
            sections, at = [], len(MAGIC) + total * len(end)
            for values in (ends, [i - least for i in ids]):
                b = EliasFano.build(np.array(values, dtype=np.uint64)).to_bytes()
                sections.append((at, len(b)))
                at += len(b)
                out.write(b)
            meta = json.dumps({"documents": len(ends), "nulls": nulls, "ids": total, "least": least, "dtype": dtype, "sections": sections}).encode()
            out.write(meta + struct.pack("<Q", len(meta)))
        files.move(attempt, final)
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([len(ends)], pa.int64()), pa.array([total], pa.int64())], names=["shard", "documents", "ids"]
        )

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts (null: empty), append ``end_id``, write shards; returns the manifest.

    The manifest (shard, documents, ids, start) has one row per file; ``start``
    counts the ids of all earlier shards. Rows that repeat an id stand side by
    side; an empty table gives one shard without documents or none at all.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(size) // SHARD_BYTES
    # Rows of one id (or none) may fill several shards: their place in the table cuts them.
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    placed = docs.withColumn("row", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = ordered.mapInArrow(_write(folder, tokenizer or default_path(), end_id), "shard int, documents long, ids long")
    manifest = materialize(written, "manifest")
    # One row per file; the running sum is over file counts, not over documents.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return materialize(manifest.withColumn("start", before), "manifest")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = TokenFile(f"{folder.rstrip('/')}/shard-{row['shard']:06d}.tok")
                nulls, least = f.meta["nulls"], f.meta["least"]
                for first in range(0, len(f), READ_DOCS):
                    ends = f.ends.block(first, READ_DOCS).astype(np.int64)
                    starts = np.r_[f.ends.select(first - 1) if first else 0, ends[:-1]]
                    known = max(0, first + len(ends) - max(first, nulls))
                    ids = [None] * (len(ends) - known) + (f.ids_of_docs.block(max(first - nulls, 0), known).astype(np.int64) + least).tolist()
                    at = 0
                    while at < len(ends):
                        # As many whole documents as READ_IDS ids hold; a longer one by itself.
                        to = max(at + 1, int(np.searchsorted(ends, starts[at] + READ_IDS, "right")))
                        ids32 = f.read(int(starts[at]), int(ends[to - 1])).astype("<u4")
                        crc = [zlib.crc32(ids32[starts[i] - starts[at] : ends[i] - starts[at]]) for i in range(at, to)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids[at:to], pa.int64()), pa.array(starts[at:to] + row["start"]), pa.array(ends[at:to] - starts[at:to]), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at = to
                f.close()

    return run


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    return manifest.select("shard", "start").repartition("shard").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the files into ``folder`` (default: a new one in the shared folder) and read them back."""
    folder = folder or shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer), folder)
