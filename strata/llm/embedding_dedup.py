"""Near-duplicate vectors by p-stable hashing.

A table projects the normalised vectors on random Gaussian directions, shifts,
and cuts each projection into steps of WIDTH; the steps together are the bucket.
Vectors at Euclidean distance c share a step with the known probability of the
2-stable (Gaussian) family, which falls with c: at cosine 0.9 (c = 0.447) it is
0.82, for unrelated directions (c = 1.41) 0.49. ``plan`` takes as many
projections to a table as keep unrelated companions rare, and as many tables as
leave a pair right at the threshold unseen with probability MISS.

Equal vectors are one class before any bucket. A bucket's classes meet in tiles
of at most 2 x TILE rows, so a bucket of any size is spread over tasks. A pair
counts in the first table that brings it together (every row carries its buckets
in all tables), after an exact cosine in double precision. Tiles return counts
and the trees of what they linked, never pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import connected_components
from strata.llm.store import materialize, ship
from strata.llm.text import mix

COSINE = 0.9
WIDTH = 2.0
# A pair at the threshold is in no common bucket with this probability.
MISS = 0.02
# Unrelated classes that share a bucket with a class, on average.
COMPANY = 0.25
# Classes of a bucket block; larger buckets are cut into blocks that meet two by two.
TILE = 1024
# Groups up to this size are compared pair by pair, many groups at once.
SMALL = 48
# Rows that a task compares together, and pairs looked at in one go.
ROWS, PAIRS = 20_000, 200_000


def collision(c: float, width: float = WIDTH) -> float:
    """Probability that two vectors at distance ``c`` fall into one step."""
    if c == 0:
        return 1.0
    r = width / c
    outside = math.erfc(r / math.sqrt(2))
    return 1 - outside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections of a table, tables) for ``n`` classes: the same recall at every size."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    wide = max(4, math.ceil(math.log(max(n, 1) / COMPANY) / -math.log(far)))
    return wide, math.ceil(math.log(MISS) / math.log1p(-(near**wide)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, wide: int, tables: int) -> np.ndarray:
    """32-bit bucket of each unit vector (row) in each table."""
    rng = np.random.default_rng([20240917, x.shape[1]])
    out = np.empty((len(x), tables), dtype=np.uint32)
    for t in range(tables):
        steps = np.floor((x @ rng.standard_normal((x.shape[1], wide)) + rng.uniform(0, WIDTH, wide)) / WIDTH).astype(np.int64).view(np.uint64)
        key = np.full(len(x), x.shape[1], dtype=np.uint64)
        for i in range(wide):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + steps[:, i])
        out[:, t] = key >> np.uint64(32)
    return out


def _sign(kind: str):
    """(vec_id, digest, vec): the components as bytes of ``kind``, null where a vector takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors = [], []
            for v in batch.column(1):
                x = v.values
                raw = None
                if x is not None and len(x) and not x.null_count:
                    x = x.to_numpy(zero_copy_only=False)
                    if np.isfinite(x).all() and x.any():
                        # A sum turns -0.0 into 0.0: such vectors are equal.
                        raw = (x + x.dtype.type(0)).astype(kind).tobytes()
                vectors.append(raw)
                digests.append(hashlib.blake2b(raw, digest_size=16).digest() if raw else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())], names=["vec_id", "digest", "vec"])

    return run


def _unpack(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision."""
    return unit(np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float64))


def _keys(wide: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch.column("vec")).to_numpy() // np.dtype(kind).itemsize
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                keys = bucket_keys(_unpack(part.column("vec"), dim, kind), wide, tables)
                packed = pa.array([k.tobytes() for k in keys], pa.binary())
                offsets = pa.array(np.arange(0, keys.size + 1, tables), pa.int32())
                buckets = pa.ListArray.from_arrays(offsets, pa.array(((np.arange(tables, dtype=np.int64) << 32) + keys).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("copies"), part.column("vec"), packed, buckets], names=["node", "copies", "vec", "keys", "buckets"]
                )

    return run


def trees(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node reachable from each of ``n`` nodes by the links (a, b)."""
    least = np.arange(n)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


def first_meeting(keys: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no bucket in a table before theirs."""
    new = np.ones(len(a), dtype=bool)
    open_ = np.arange(len(a))
    for t in range(int(table.max(initial=0))):
        open_ = open_[table[open_] > t]
        met = keys[a[open_], t] == keys[b[open_], t]
        new[open_[met]] = False
        open_ = open_[~met]
        if not len(open_):
            break
    return new


def linked_pairs(x: np.ndarray, keys: np.ndarray, table: np.ndarray, group: np.ndarray, block: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the linked pairs of each group that meet there first.

    Rows of a group stand together, those of block 0 before those of block 1. A
    group with both pairs only rows of different blocks.
    """
    found = []
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    crossed = np.add.reduceat(block, first) > 0
    few = (size <= SMALL) & ~crossed
    rows = np.flatnonzero(np.repeat(few, size))
    rest = np.repeat(first + size, size)[rows] - rows - 1
    for lot in np.array_split(np.arange(len(rows)), max(1, -(-int(rest.sum()) // PAIRS))):
        more = rest[lot]
        a = np.repeat(rows[lot], more)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(more) - more, more)
        new = first_meeting(keys, table[a], a, b)
        a, b = a[new], b[new]
        good = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        found.append((a[good], b[good]))
    for g in np.flatnonzero(~few).tolist():
        lo, hi = int(first[g]), int(first[g] + size[g])
        held = keys[lo:hi, : int(table[lo])]
        if held.shape[1] and (held == held[0]).all(axis=0).any():
            continue  # all its pairs have met
        mid = lo + int((block[lo:hi] == 0).sum()) if crossed[g] else hi
        right = mid if crossed[g] else lo
        for i in range(lo, mid, 256):
            near = x[i : min(i + 256, mid)] @ x[right:hi].T >= cosine
            a, b = np.nonzero(near)
            a, b = a + i, b + right
            if not crossed[g]:
                a, b = a[a < b], b[a < b]
            new = first_meeting(keys, table[a], a, b)
            found.append((a[new], b[new]))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True)) if found else (first[:0], first[:0])


def _link(cosine: float, kind: str):
    def judge(rows: pa.Table) -> pa.RecordBatch:
        bucket, left, right, block, node, copies = (rows.column(c).to_numpy() for c in ("bucket", "left", "right", "block", "node", "copies"))
        sizes = pa.compute.binary_length(rows.column("vec")).to_numpy()
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), dtype=np.uint32).reshape(len(node), -1)
        opens = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]) | (sizes[1:] != sizes[:-1])])
        group, pairs = np.cumsum(opens), []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            x = _unpack(rows.column("vec").take(pa.array(own)), size // np.dtype(kind).itemsize, kind)
            a, b = linked_pairs(x, keys[own], bucket[own] >> 32, group[own], (block != left)[own].astype(np.int64), cosine)
            pairs.append((own[a], own[b]))
        a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
        names, at = np.unique(node, return_inverse=True)
        count = np.bincount(at[a], copies[b], len(names)) + np.bincount(at[b], copies[a], len(names))
        root = names[trees(at[a], at[b], len(names))]
        some = count > 0
        return pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(count[some].astype(np.int64)), pa.array(root[some])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            # The last group may go on in the next batch.
            bucket, left, right = (rows.column(c).to_numpy() for c in ("bucket", "left", "right"))
            same = (bucket == bucket[-1]) & (left == left[-1]) & (right == right[-1])
            cut = int(np.argmax(same))
            if cut:
                yield judge(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield judge(rows)

    return run


def linked_vectors(rows: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors of one dimension are linked from ``cosine`` on. Vectors that are
    null, empty, zero or hold null or non-finite components link with nothing.
    Rows that repeat an id are vectors of their own in ``n_links`` and one node
    of a component. A row with a null id is never linked: its component is null
    and it is kept. Other columns are ignored, whatever their names; an empty
    table gives no rows.
    """
    ship(rows.sparkSession)
    # Single precision moves as it is; all arithmetic is in double precision.
    single = rows.select(vector_col).dtypes[0][1] == "array<float>"
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    signed = materialize(given.mapInArrow(_sign(kind), "vec_id long, digest binary, vec binary"), "vectors")
    usable = signed.filter("digest is not null and vec_id is not null")
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    # Numbered as they are written, so that a retry cannot renumber them.
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    wide, tables = plan(classes.count(), cosine)
    hashed = materialize(
        classes.select("node", "copies", "vec").mapInArrow(_keys(wide, tables, kind), "node long, copies long, vec binary, keys binary, buckets array<long>"), "hashed"
    )
    members = hashed.select("node", F.explode("buckets").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    live = members.join(shared, "bucket").withColumn("blocks", F.ceil(F.col("size") / TILE).cast("int"))
    live = live.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A row of a cut bucket meets every other block in a tile of the two.
    tiles = live.select("node", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("node", "bucket", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    full = tiles.join(hashed.select("node", "copies", "vec", "keys"), "node")
    ordered = full.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right", "block")
    links = materialize(ordered.select("bucket", "left", "right", "block", "node", "copies", "vec", "keys").mapInArrow(_link(cosine, kind), "node long, links long, root long"), "links")
    named = usable.select("vec_id", "digest").join(classes.select("digest", "node", "copies", "least"), "digest")
    # Rows that share an id are one node: their classes hang together.
    twice = named.groupBy("vec_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all")).filter(F.size("all") > 1)
    edges = links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(twice.select("a", F.explode("all").alias("b")))
    found = connected_components(edges)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.join(found, "node", "left").join(counts, "node", "left").select(
        "digest", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(lowest, "root").select("digest", "n_links", "component_id")
    joined = signed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(placed, "digest", "left")
    # A row without a usable vector belongs to its id.
    own = joined.withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return own.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
