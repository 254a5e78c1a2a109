"""Best-fit packing by a configuration linear program over the length histogram.

A configuration says how many pieces of each length share one sequence. The
program asks for the fewest configurations that cover the histogram. It is
solved by multiplicative weights: each round prices lengths, a knapsack
dynamic program over the capacity finds the best configuration with the length
of the greatest weight, and lengths that it covers lose weight, until all are
covered. The fractional solution is rounded: whole uses first, then one more
use where a fraction and pieces are left. The rest, REST of the pieces and what
rounding leaves, is packed best fit: the longest piece left and the knapsack
for the rest of its sequence, repeated as often as the counts allow. Only if
that is not within NEAR of the volume bound, best fit alone is tried too, and
the plan with the fewest sequences stands.

Only the histogram, at most ``capacity`` numbers, comes to the driver, and
only the configurations, at most about one per length and round, go back.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.store import materialize, ship, text_batches
from strata.llm.tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2
# A round covers at most this share of a length; finer steps for few lengths.
MIN_STEP, MAX_STEP, STEP_LENGTHS, ETA = 1 / 64, 1 / 8, 8192, 0.02
# A round prices this many of the least covered lengths first, then four times as many.
WANTED = 32
# Among fillings of equal worth longer pieces go first: short ones fill the last sequences.
LONGER = 1e-5
# Share of the pieces that the rounding leaves to best fit: those of the least full configurations.
REST = 1 / 8
# Beyond the volume bound by more than this share, best fit alone is tried as well.
NEAR = 0.001

_log = logging.getLogger(__name__)

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


def price(lengths: np.ndarray, value: np.ndarray, counts: np.ndarray, capacity: int) -> Config:
    """Knapsack: the most valuable multiset of lengths that fits, none used beyond ``counts``."""
    parts = []  # (room, value, length index, uses): counts split into 1, 2, 4, ... uses
    for k, (length, v, n) in enumerate(zip(lengths.tolist(), value.tolist(), counts.tolist(), strict=True)):
        n, uses = min(n, capacity // length), 1
        while n > 0:
            uses = min(uses, n)
            parts.append((length * uses, v * uses, k, uses))
            n, uses = n - uses, 2 * uses
    best = np.zeros(capacity + 1)
    took = np.zeros((len(parts), capacity + 1), dtype=bool)
    for i, (room, v, _, _) in enumerate(parts):
        with_it = best[: capacity + 1 - room] + v
        np.greater(with_it, best[room:], out=took[i, room:])
        np.maximum(with_it, best[room:], out=best[room:])
    used: dict[int, int] = {}
    c = capacity
    for i in range(len(parts) - 1, -1, -1):
        if took[i, c]:
            room, _, k, uses = parts[i]
            used[int(lengths[k])] = used.get(int(lengths[k]), 0) + uses
            c -= room
    return tuple(sorted(used.items(), reverse=True))


def _weights(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int | None, step: float) -> dict[Config, float]:
    """Configurations and their fractional uses, which cover every length (unless ``rounds`` ends them).

    Every round brings some length one ``step`` on or to its end, so there are
    at most lengths * (1 + 1 / step) of them.
    """
    at = {int(k): i for i, k in enumerate(lengths)}
    done, plan = np.zeros(len(need)), {}
    while (done < 1 - 1e-9).any() and rounds != 0:
        rounds = rounds and rounds - 1
        # The weight of a length falls with the share of it that is covered; a token has its length's weight.
        weight = np.where(done < 1 - 1e-9, np.exp(-ETA * done), 0.0)
        first = int(np.flatnonzero(weight == weight.max())[-1])
        room, counts, config = capacity - int(lengths[first]), need.copy(), {int(lengths[first]): 1}
        counts[first] -= 1
        fits = np.flatnonzero((weight > 0) & (lengths <= room) & (counts > 0))
        for wanted in (WANTED, 4 * WANTED):
            few = fits[np.argpartition(-weight[fits], wanted)[:wanted]] if len(fits) > wanted else fits
            rest = price(lengths[few], lengths[few] * weight[few] + LONGER * lengths[few] ** 2, counts[few], room)
            if sum(k * n for k, n in rest) == room or few is fits:
                break
        for k, n in rest:
            config[k] = config.get(k, 0) + n
        times = min(min(step, 1 - done[at[k]]) * need[at[k]] / n for k, n in config.items())
        key = tuple(sorted(config.items(), reverse=True))
        plan[key] = plan.get(key, 0.0) + times
        for k, n in key:
            done[at[k]] += times * n / need[at[k]]
    return plan


def solve_parts(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None, step: float | None = None) -> tuple[list[tuple[Config, int]], list[tuple[Config, int]]]:
    """What the rounded program packs and what best fit packs: configurations and how often to use each.

    Pieces of a whole sequence's length come with the program's.
    """
    full = [(((capacity, 1),), histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    if not len(lengths):
        return full, []
    need = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    step = step or min(MAX_STEP, max(MIN_STEP, len(lengths) / STEP_LENGTHS))
    program, left = _rounded(_weights(lengths, need, capacity, rounds, step), lengths, need, capacity)
    rest = _best_fit(lengths, left, capacity)
    if sum(times for _, times in program + rest) > (1 + NEAR) * -(-int(lengths @ need) // capacity):
        alone = _best_fit(lengths, need, capacity)
        if sum(times for _, times in alone) < sum(times for _, times in program + rest):
            program, rest = [], alone
    return full + program, rest


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int | None = None, step: float | None = None) -> list[tuple[Config, int]]:
    """Configurations and how often to use each; together they hold the histogram exactly."""
    program, rest = solve_parts(histogram, capacity, rounds, step)
    pieces = [sum(times * sum(n for k, n in config if k < capacity) for config, times in p) for p in (program, rest)]
    _log.info("packing: %d of %d pieces below the capacity placed by the rounded program, %d by best fit", pieces[0], sum(pieces), pieces[1])
    return program + rest


def _rounded(plan: dict[Config, float], lengths: np.ndarray, need: np.ndarray, capacity: int) -> tuple[list[tuple[Config, int]], np.ndarray]:
    """Whole uses of the plan's configurations, and the counts that they leave.

    The least full configurations, with REST of the pieces, are left out: best
    fit fills them better together with what rounding leaves.
    """
    at = {int(k): i for i, k in enumerate(lengths)}
    left, uses = need.tolist(), {}

    def use(config: Config, times: int) -> None:
        whole = min([times, *(left[at[k]] // n for k, n in config)])
        if whole:
            uses[config] = uses.get(config, 0) + whole
            for k, n in config:
                left[at[k]] -= whole * n

    taken, pieces = [], 0.0
    for config in sorted(plan, key=lambda c: capacity - sum(k * n for k, n in c)):
        pieces += plan[config] * sum(n for _, n in config)
        if pieces > (1 - REST) * need.sum():
            break
        taken.append(config)
    for config in taken:
        use(config, int(plan[config] + 1e-9))
    for config in sorted(taken, key=lambda c: -(plan[c] % 1)):
        if plan[config] % 1 > 1e-9:
            use(config, 1)
    return list(uses.items()), np.array(left, dtype=np.int64)


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[Config, int]]:
    left, out = left.copy(), []
    at = {int(k): i for i, k in enumerate(lengths)}
    while (left > 0).any():
        first = int(lengths[left > 0].max())
        rest = left.copy()
        rest[at[first]] -= 1
        fits = (rest > 0) & (lengths <= capacity - first)
        config = {first: 1}
        if fits.any():
            # Fullest first; among equals, longer pieces.
            for k, n in price(lengths[fits], lengths[fits] + 1e-9 * lengths[fits] ** 2, rest[fits], capacity - first):
                config[k] = config.get(k, 0) + n
        whole = min(int(left[at[k]]) // n for k, n in config.items())
        out.append((tuple(sorted(config.items(), reverse=True)), whole))
        for k, n in config.items():
            left[at[k]] -= whole * n
    return out


class Places:
    """Where the j-th piece of a length goes, in closed form."""

    def __init__(self, plan: list[tuple[Config, int]]):
        base, slots = 0, {}
        for config, times in plan:
            offset = 0
            for k, n in config:
                slots.setdefault(k, []).append((n * times, base, n, offset))
                offset += k * n
            base += times
        self.sequences = base
        self.by_length = {}
        for k, rows in slots.items():
            count, first, each, offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
            self.by_length[k] = (np.cumsum(count) - count, first, each, offset)

    def __call__(self, length: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, first, each, offset = self.by_length[length]
        c = np.searchsorted(begin, j, "right") - 1
        within = j - begin[c]
        return first[c] + within // each[c], offset[c] + within % each[c] * length


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def _cut(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)  # pieces of each length met in this task
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = enc.encode(text.as_py()) + end
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for p in range(len(cuts) - 1):
                    k = cuts[p + 1] - cuts[p]
                    rows.append((i, p, cuts[p], k, zlib.crc32(raw[4 * cuts[p] : 4 * cuts[p + 1]]), task, int(seen[k])))
                    seen[k] += 1
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
                )

    return run


def _place(plan: list[tuple[Config, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(plan)
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for k in np.unique(length):
                of = length == k
                sequence[of], offset[of] = places(int(k), rank[of])
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    Every document (null text: empty) is its ids and ``end_id``. Longer ones
    are cut into pieces of ``capacity`` ids, the first may be shorter.
    Rows that repeat an id, or have none, are documents of their own. An empty
    table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with text_batches(docs.sparkSession):
        pieces = materialize(docs.mapInArrow(_cut(tokenizer or default_path(), capacity, end_id), PIECES), "pieces")
    # Ranks without a sort: a place within the writing task, and each task's first rank.
    tasks = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(tasks.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "ranks")
    histogram = {r.length: r.n for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = solve(histogram, capacity)
    ranked = pieces.join(first.select("length", "task", "first"), ["length", "task"]).withColumn("rank", F.col("first") + F.col("place"))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(plan), out)
