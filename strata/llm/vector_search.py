"""Exact nearest neighbours by a block matrix join over int8 codes.

Every vector is coded once as ``scale * int8``, together with the length of what
the code misses. A tile is a block of queries against a block of rows: one
product of the codes gives the distances between codes, and the two missed
lengths bound the true distance from both sides. A row survives a query if its
lower bound does not exceed the k-th smallest upper bound of the tile, nor the
query's k-th distance in the tiles before. Only survivors are recomputed in
double precision from the original vectors, and a bounded heap per query merges
them tile by tile; Spark merges the heaps of the tasks.

The queries are stated in advance and come in blocks, each block's number is
the join key, so a task holds one block of queries and one of rows at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.store import materialize, ship

K = 10
QUERY_BLOCK, ROW_BLOCK = 512, 4096
# Query blocks that a task joins its rows with at a time.
PART_BLOCKS = 512
# Queries whose heaps a task keeps; those longest unseen are emitted beyond it.
HELD_QUERIES = 65_536
BLOCK = "block long, dim int, ids binary, codes binary, scales binary, missed binary, vectors binary"
_PARTS = ("ids", "codes", "scales", "missed", "vectors")
# Differences of this size or its inverse are scaled before they are squared.
LARGE = 1e140


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, missed length) of the rows of ``x`` (float64); any finite size."""
    top = np.abs(x).max(axis=1)
    top = np.where(top > 0, top, 1.0)
    part = x / top[:, None]
    codes = np.rint(part * 127.0)
    missed = top * np.sqrt(((part - codes / 127.0) ** 2).sum(axis=1))
    return codes.astype(np.int8), top / 127.0, missed


def bounds(queries: tuple, rows: tuple) -> tuple[np.ndarray, np.ndarray, float]:
    """Lower and upper bounds of all distances of a tile, and the unit both are in.

    Products of int8 codes are integers below 2**24 up to 1040 dimensions and
    come out of a float32 product exactly; wider codes are multiplied in double.
    The unit is the largest component of the tile, so nothing overflows.
    """
    (q, qs, qe), (r, rs, re) = queries, rows
    kind = np.float64 if q.shape[1] > 1040 else np.float32
    unit = 127.0 * max(qs.max(initial=0.0), rs.max(initial=0.0)) or 1.0
    qs, rs, qe, re = qs / unit, rs / unit, qe / unit, re / unit
    dots = (q.astype(kind) @ r.astype(kind).T).astype(np.float64) * qs[:, None] * rs[None, :]
    q2 = (q.astype(np.float64) ** 2).sum(axis=1) * qs**2
    r2 = (r.astype(np.float64) ** 2).sum(axis=1) * rs**2
    size = q2[:, None] + r2[None, :]
    coded = np.sqrt(np.maximum(size - 2 * dots, 0.0))
    # Rounding of the three sums, and what is too small to be squared, can move a distance by this much.
    blur = np.sqrt(size) * 1e-7 + 1e-150
    slack = qe[:, None] + re[None, :] + blur
    return coded - slack, coded + slack, unit


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    with np.errstate(over="ignore"):
        d = rows - query
        most = np.abs(d).max(axis=1, initial=0.0)
        out = np.sqrt((d**2).sum(axis=1))
    odd = (most > LARGE) | ((most < 1 / LARGE) & (most > 0))
    if odd.any():
        far = np.isinf(most[odd])
        unit = np.where(far, 1.0, most[odd])
        out[odd] = np.where(far, np.inf, unit * np.sqrt((np.where(far[:, None], 0.0, d[odd] / unit[:, None]) ** 2).sum(axis=1)))
    return out


def _blocks(size: int, spread: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, vectors = zip(*waiting.pop(dim), strict=True)
            ids, vectors = np.array(ids, dtype=np.int64), np.array(vectors)
            codes, scales, missed = encode(vectors)
            # The number only has to spread blocks evenly and stay the same on a retry.
            block = int(ids.min() * 2654435761 % 2**31) % max(1, spread)
            parts = (ids, codes, scales, missed, vectors.astype(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([dim], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)],
                names=["block", "dim", *_PARTS],
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                if values is None or len(values) == 0 or values.null_count:
                    continue
                x = values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                waiting.setdefault(len(x), []).append((i, x))
                if len(waiting[len(x)]) == size:
                    yield flush(len(x))
        for dim in list(waiting):
            yield flush(dim)

    return run


def _unpack(batch: pa.RecordBatch, at: int, prefix: str, kind: str) -> tuple:
    dim = batch.column("dim")[at].as_py()
    ids, codes, scales, missed, vectors = (
        np.frombuffer(batch.column(prefix + c)[at].as_buffer(), dtype=t) for c, t in zip(_PARTS, (np.int64, np.int8, np.float64, np.float64, kind), strict=True)
    )
    return ids, (codes.reshape(-1, dim), scales, missed), vectors.astype(np.float64).reshape(-1, dim)


def _tiles(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By query block: its ids, and a heap of (-distance, -id) for each, the worst first.
        held: dict[int, tuple[np.ndarray, list[list]]] = {}

        def emit(name: int) -> pa.RecordBatch:
            ids, heaps = held.pop(name)
            sizes = [len(h) for h in heaps]
            flat = [e for h in heaps for e in h]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, sizes), pa.int64()), pa.array([-e[1] for e in flat], pa.int64()), pa.array([-e[0] for e in flat], pa.float64())],
                names=["query_id", "vec_id", "score"],
            )

        for batch in batches:
            for at in range(batch.num_rows):
                qi, qc, q = _unpack(batch, at, "q", kind)
                ri, rc, r = _unpack(batch, at, "", kind)
                name = batch.column("name")[at].as_py()
                if name not in held and sum(len(ids) for ids, _ in held.values()) + len(qi) > HELD_QUERIES and held:
                    yield emit(next(iter(held)))
                ids, heaps = held.pop(name, None) or (qi, [[] for _ in qi])
                held[name] = (ids, heaps)  # the latest stands last
                low, high, unit = bounds(qc, rc)
                own = qi[:, None] == ri[None, :]
                high[own] = low[own] = np.inf
                n = min(k, len(ri))
                limit = np.partition(high, n - 1, axis=1)[:, n - 1]
                # A heap that is full bounds what may enter; a little more for the division.
                full = np.array([-h[0][0] / unit * (1 + 1e-9) if len(h) == k else np.inf for h in heaps])
                limit = np.minimum(limit, full)
                for j, heap in enumerate(heaps):
                    live = np.flatnonzero((low[j] <= limit[j]) & ~own[j])
                    for d, i in zip(distances(r[live], q[j]).tolist(), ri[live].tolist(), strict=True):
                        if len(heap) < k:
                            heapq.heappush(heap, (-d, -i))
                        elif (-d, -i) > heap[0]:
                            heapq.heapreplace(heap, (-d, -i))
        for name in list(held):
            yield emit(name)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, by Euclidean distance.

    Nearest first, ties to the smaller id; all rows if there are fewer than k.
    Rows with the query's id are its own and do not count. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without
    an id, take no part; vectors meet only those of their own dimension.
    Repeated rows are rows of their own. Components may have any finite size; a
    distance beyond the largest double is infinite.
    """
    ship(rows.sparkSession)
    # Single precision moves as it is; all arithmetic is in double precision.
    kind = "<f4" if rows.select(vector_col).dtypes[0][1] == queries.select(vector_col).dtypes[0][1] == "array<float>" else "<f8"
    of = [F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v")]
    valid = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    asked = queries.select(*of).filter(valid).repartition(blocks).mapInArrow(_blocks(QUERY_BLOCK, 2**31, kind), BLOCK)
    # Blocks are numbered after they are written, so that a retry cannot renumber them.
    asked = materialize(asked.withColumn("name", F.monotonically_increasing_id()), "queries").select("dim", "name", *[F.col(c).alias(f"q{c}") for c in _PARTS])
    stored = materialize(rows.select(*of).filter(valid).mapInArrow(_blocks(ROW_BLOCK, 2**31, kind), BLOCK), "rows")
    groups = max(1, min(stored.count(), spread(rows)))
    parts = max(1, -(-asked.count() // PART_BLOCKS))
    # Each query block goes to every group of row blocks: a group reads all queries once, a part of
    # them at a time. Both sides are shuffled: as many copies of the queries as there are groups are
    # far beyond the file size that a broadcast is planned by, and would pass through the driver.
    stored = stored.withColumn("group", F.pmod("block", F.lit(groups))).withColumn("part", F.explode(_numbers(parts)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts))).withColumn("group", F.explode(_numbers(groups)))
    tiles = stored.join(asked.hint("merge"), ["group", "part", "dim"]).select("dim", "name", *_PARTS, *[f"q{c}" for c in _PARTS])
    found = tiles.mapInArrow(_tiles(k, kind), "query_id long, vec_id long, score double")
    # Ranking keeps k rows of a query in each task before the exchange.
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def spread(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
