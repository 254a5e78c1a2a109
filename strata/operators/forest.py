"""Bagged trees whose bags are known: out-of-bag error and importance (O-70, O-71).

Spark ML draws the bags of a forest from the partitioning and does not give them
back, so nothing can be said about the rows outside of them. Here a row's weight
in each tree is a Poisson(1) draw from a hash of its key (``bag_weights``): it
follows from the row alone, whatever the partitions, and is computed anew where
it is needed instead of being stored.

* ``quantile_cuts`` finds exact quantiles by counting ever narrower cells; the
  features are binned at them once, and the binned rows are written.
* ``grow`` grows all trees together, one pass over the rows per level: tasks
  count rows and positives by (tree, node, feature, bin), one aggregate sums the
  counts, and the best cut of each node is chosen in Spark. The counts are whole
  numbers, so 4 or 16,000 partitions give the same trees.
* ``oob_error_curve`` and ``oob_importance`` send each row through the trees
  that did not see it.

What returns to the driver is the size of the model: cut points, one row per
node. A pass counts trees in lots whose counters fit ``COUNTER_BYTES``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.operators.ml import FeatureSpec, bin_sql, key_hash
from strata.operators.ranks import doubles, order_statistics
from strata.session import checkpoint_dir, ship

# Fixed values of the bag hash: a prime modulus and two of its primitive roots.
MODULUS, FIRST_ROOT, SECOND_ROOT = 2147483647, 48271, 16807
BINS, DEPTH, TREES, SEED = 32, 5, 100, 123
# Counters that a task holds while it counts one lot of trees.
COUNTER_BYTES = 64 << 20
# Rows that a task gathers before it looks for equal ones among them.
CHUNK_ROWS = 1 << 16
# Rows whose values are permuted among each other.
PERMUTED_ROWS = 10_000


@functools.cache
def poisson_steps() -> list[int]:
    """Hash values from which a draw is at least 1, 2, ...: Poisson(1) over the modulus."""
    steps, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        step = round(total * MODULUS)
        if step >= MODULUS:
            return steps
        steps.append(step)
        k += 1


def tree_multipliers(tree: int) -> tuple[int, int]:
    return pow(FIRST_ROOT, tree + 1, MODULUS), pow(SECOND_ROOT, tree + 1, MODULUS)


def bag_weights(h: np.ndarray, tree: int) -> np.ndarray:
    """How often the rows with key hashes ``h`` are in the tree's bag."""
    a, c = tree_multipliers(tree)
    u = h * a + c
    # The remainder by a power of two less one: its digits' sum, twice, for a sum may pass it once.
    u = (u & MODULUS) + (u >> 31)
    u = ((u & MODULUS) + (u >> 31)).astype(np.int32)
    u[u == MODULUS] = 0
    w = np.zeros(len(u), dtype=np.uint8)
    for step in poisson_steps():
        w += u >= step
    return w


def bags(rows: DataFrame, trees: int = TREES) -> DataFrame:
    """(tree, in_bag, out_of_bag, weight): rows inside and outside each tree's bag, and the sum of weights."""
    drawn = [F.struct(F.lit(t).alias("tree"), *[F.lit(v).cast("long").alias(n) for n, v in zip("ac", tree_multipliers(t), strict=True)]) for t in range(trees)]
    # One expression for all trees: their multipliers are data.
    each = rows.select("h", F.inline(F.array(*drawn))).select("tree", _draw(F.col("h"), F.col("a"), F.col("c")).alias("w"))
    return each.groupBy("tree").agg(
        F.count_if(F.col("w") > 0).alias("in_bag"), F.count_if(F.col("w") == 0).alias("out_of_bag"), F.sum("w").cast("long").alias("weight")
    )


def _draw(h: Column, a: Column, c: Column) -> Column:
    u = (h * a + c) % F.lit(MODULUS)
    return sum(((u >= F.lit(s)).cast("int") for s in poisson_steps()), F.lit(0))


def bag_weight_column(h: str, tree: int) -> Column:
    """The same as an expression."""
    a, c = tree_multipliers(tree)
    return _draw(F.col(h), F.lit(a), F.lit(c))


# ---------------------------------------------------------------- binning


def quantile_cuts(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Exact cut points: the distinct k/bins quantiles of each column above its least value.

    The quantile is the least value that at least that share of the values does
    not exceed; null and NaN don't count.
    """
    found = order_statistics(df, {c: lambda n: [max(1, -(-k * n // bins)) for k in range(1, bins)] + [1] for c in columns})
    return {c: sorted({v for v in found[c].values() if v > found[c][1]}) if found[c] else [] for c in columns}


@dataclass
class Binned:
    """Binned rows (``h``, ``y``, one small integer per encoded column), their
    encoded columns and the source column of each."""

    rows: DataFrame
    encoded: list[str]
    source: list[str]
    cuts: dict[str, list[float]]
    levels: list[tuple[str, str]]

    @property
    def width(self) -> int:
        """Bins of a column at most, the one of missing values included."""
        return max([len(c) for c in self.cuts.values()], default=0) + 2


def _bin_rows(numeric: list[str], levels: list[tuple[str, str]], cuts: dict[str, list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column("h"), batch.column("y")]
            for c in numeric:
                x = doubles(batch, c)
                at = np.searchsorted(np.array(cuts[c]), x, side="right")
                out.append(pa.array(np.where(np.isnan(x), len(cuts[c]) + 1, at).astype(np.int16)))
            for c, level in levels:
                held = batch.column(c).to_pylist()
                out.append(pa.array(np.array([v == level for v in held], dtype=np.int16)))
            yield pa.RecordBatch.from_arrays(out, names=["h", "y", *(f"x{i}" for i in range(len(out) - 2))])

    return run


def bin_features(df: DataFrame, spec: FeatureSpec, keys: Sequence[str], bins: int = BINS, cuts: dict[str, list[float]] | None = None, levels: dict[str, list[str]] | None = None) -> Binned:
    """Bin the numeric features at their quantiles, spell out categorical ones, write the rows.

    A value of a cut point or more is above the cut; a missing value has the
    highest bin of its column. A categorical column gives one 0/1 column per
    level (sorted; a missing or unknown one is 0 in all). Rows without a label
    are left out. ``cuts`` and ``levels`` of another table can be given.
    """
    cuts = cuts if cuts is not None else quantile_cuts(df, spec.numeric, bins) if spec.numeric else {}
    if levels is None:
        levels = {c: sorted(r[0] for r in df.select(F.col(c).cast("string")).distinct().collect() if r[0] is not None) for c in spec.categorical}
    pairs = [(c, v) for c in spec.categorical for v in levels[c]]
    given = df.select(
        key_hash(keys, df).alias("h"), F.col(spec.label).cast("int").alias("y"), *spec.numeric, *[F.col(c).cast("string").alias(c) for c in spec.categorical]
    ).filter("y is not null")
    names = [f"x{i}" for i in range(len(spec.numeric) + len(pairs))]
    schema = ", ".join(["h long", "y int", *(f"{n} short" for n in names)])
    ship(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    binned = given.mapInArrow(_bin_rows(list(spec.numeric), pairs, cuts), schema)
    # Rows of equal bins and label stand together, so that trees are walked once for all of them; the
    # hash deals the rows of a frequent cell to several partitions. They are read once per level.
    order = [*names, "y", "h"]
    rows = binned.checkpoint(eager=True).repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    source = [*spec.numeric, *(c for c, _ in pairs)]
    encoded = [*spec.numeric, *(f"{c}={v}" for c, v in pairs)]
    return Binned(rows, encoded, source, cuts, pairs)


# ---------------------------------------------------------------- growing


@dataclass
class Tree:
    """A tree in heap order: node i has children 2i and 2i + 1; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: dict[int, float] = field(default_factory=dict)

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 << depth
        return cls(np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64), np.zeros(size))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row (a column of ``x`` per encoded feature)."""
        node = np.ones(x.shape[0], dtype=np.int64)
        every = np.arange(x.shape[0])
        for _ in range(len(self.feature).bit_length() - 2):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + (x[every, np.maximum(f, 0)] > self.cut[node]), node)
        return node

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Class of each row: 1 where over half of the leaf's bag is 1."""
        return (self.value[self.route(x)] > 0.5).astype(np.int64)


def candidates(tree: int, node: int, features: int, tried: int, seed: int = SEED) -> np.ndarray:
    """The features that a node may be cut by."""
    if tried >= features:
        return np.arange(features)
    return np.sort(np.random.default_rng([seed, tree, node]).choice(features, tried, replace=False))


def _matrix(batch: pa.RecordBatch | pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.empty((batch.num_rows, n), dtype=np.int64)
    for i in range(n):
        x[:, i] = batch.column(f"x{i}").to_numpy()
    return batch.column("h").to_numpy(), batch.column("y").to_numpy().astype(np.int64), x


def _cells(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key hashes of the rows, first row, label and bins of each run of equal rows), CHUNK_ROWS or more at a time."""
    held: list[pa.RecordBatch] = []

    def runs() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h, y, x = _matrix(pa.Table.from_batches(held), n)
        held.clear()
        first = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (x[1:] != x[:-1]).any(axis=1)])
        return h, first, y[first], x[first]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS:
            yield runs()
    if held:
        yield runs()


def _count_bins(trees: dict[int, Tree], open_: dict[int, list[int]], features: int, tried: int, width: int, bagged: bool, seed: int):
    """Weights and positive weights by (tree, node, feature, bin) of the open nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, asked, n, s = {}, {}, {}, {}
        for t, nodes in open_.items():
            place[t] = np.full(len(trees[t].feature), -1, dtype=np.int64)
            place[t][nodes] = np.arange(len(nodes))
            asked[t] = np.array([candidates(t, node, features, tried, seed) for node in nodes])
            n[t], s[t] = (np.zeros(asked[t].size * width, dtype=np.int64) for _ in range(2))
        for h, first, y, x in _cells(batches, features):
            size = np.diff(np.r_[first, len(h)])
            for t in open_:
                w = np.add.reduceat(bag_weights(h, t), first, dtype=np.int64) if bagged else size
                at = place[t][trees[t].route(x)]
                use = np.flatnonzero((at >= 0) & (w > 0))
                at, weight, label = at[use], w[use], y[use]
                for j in range(asked[t].shape[1]):
                    key = (at * asked[t].shape[1] + j) * width + x[use, asked[t][at, j]]
                    n[t] += np.bincount(key, weight, len(n[t])).astype(np.int64)
                    s[t] += np.bincount(key, weight * label, len(s[t])).astype(np.int64)
        for t, nodes in open_.items():
            some = np.flatnonzero(n[t])
            slot, bins = np.divmod(some, width)
            which, j = np.divmod(slot, asked[t].shape[1])
            columns = [np.full(len(some), t), np.array(nodes)[which], asked[t][which, j], bins, n[t][some], s[t][some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["tree", "node", "feature", "bin", "n", "s"])

    return run


def best_cuts(counts: DataFrame) -> DataFrame:
    """(tree, node, feature, bin, gain, n, s, n_left, s_left): the best cut of each node.

    ``counts``: (tree, node, feature, bin, n, s). A cut sends bins up to ``bin``
    left. The gain is the fall of n * Gini impurity; ties go to the least
    feature, then the least bin. Nodes that no cut improves are not returned.
    """
    sums = counts.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").cast("long").alias("n"), F.sum("s").cast("long").alias("s"))
    one = Window.partitionBy("tree", "node", "feature")  # a row per bin
    upto = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.select(
        "tree", "node", "feature", "bin", F.sum("n").over(upto).alias("n_left"), F.sum("s").over(upto).alias("s_left"), F.sum("n").over(one).alias("n"), F.sum("s").over(one).alias("s")
    ).filter("n_left < n")

    def pure(s, n):
        return F.col(s).cast("double") * F.col(s) / F.col(n)

    right = (F.col("s") - F.col("s_left")).cast("double")
    gain = F.lit(2.0) * (pure("s_left", "n_left") + right * right / (F.col("n") - F.col("n_left")) - pure("s", "n"))
    cut = cut.withColumn("gain", gain).filter("gain > 1e-9 * n")
    order = F.struct("gain", -F.col("feature"), -F.col("bin"))
    best = cut.groupBy("tree", "node").agg(F.max_by(F.struct("feature", "bin", "gain", "n", "s", "n_left", "s_left"), order).alias("best"))
    return best.select("tree", "node", "best.*")


def grow(binned: Binned, trees: int = TREES, depth: int = DEPTH, tried: int | None = None, bagged: bool = True, seed: int = SEED) -> list[Tree]:
    """Grow all trees level by level; ``tried`` features per node (default: the root of their number)."""
    features = len(binned.encoded)
    tried = tried or max(1, math.ceil(math.sqrt(features)))
    tried = min(tried, features)
    grown = {t: Tree.empty(depth) for t in range(trees)}
    open_ = {t: [1] for t in grown}
    for level in range(depth):
        per_tree = max(len(v) for v in open_.values()) * tried * binned.width * 16
        lot = max(1, COUNTER_BYTES // per_tree)
        names = list(open_)
        found = []
        for i in range(0, len(names), lot):
            part = {t: open_[t] for t in names[i : i + lot]}
            counts = binned.rows.mapInArrow(
                _count_bins({t: grown[t] for t in part}, part, features, tried, binned.width, bagged, seed),
                "tree long, node long, feature long, bin long, n long, s long",
            )
            found += best_cuts(counts).collect()  # a row per open node
        after: dict[int, list[int]] = {}
        for r in found:
            tree = grown[r["tree"]]
            tree.feature[r["node"]], tree.cut[r["node"]], tree.gain[r["node"]] = r["feature"], r["bin"], r["gain"]
            for node, n, s in ((r["node"], r["n"], r["s"]), (2 * r["node"], r["n_left"], r["s_left"]), (2 * r["node"] + 1, r["n"] - r["n_left"], r["s"] - r["s_left"])):
                tree.value[node] = s / n
                if node != r["node"] and level + 1 < depth and 0 < s < n:
                    after.setdefault(r["tree"], []).append(node)
        if level == 0:
            _fill_roots(binned, grown, [t for t in grown if grown[t].feature[1] < 0], bagged)
        open_ = {t: sorted(v) for t, v in after.items()}
        if not open_:
            break
    return list(grown.values())


def _fill_roots(binned: Binned, grown: dict[int, Tree], bare: list[int], bagged: bool) -> None:
    """Shares of trees that are a single leaf."""
    if not bare:
        return
    w = {t: bag_weight_column("h", t) if bagged else F.lit(1) for t in bare}
    row = binned.rows.agg(*[F.try_divide(F.sum(w[t] * F.col("y")), F.sum(w[t])).alias(str(t)) for t in bare]).first()
    for t in bare:
        grown[t].value[1] = row[str(t)] or 0.0


def root_gains(binned: Binned) -> DataFrame:
    """(feature, bin, gain, n, s, n_left, s_left): the best cut of all rows by each encoded column."""
    features = len(binned.encoded)
    count = _count_bins({0: Tree.empty(0)}, {0: [1]}, features, features, binned.width, False, SEED)
    counts = binned.rows.mapInArrow(count, "tree long, node long, feature long, bin long, n long, s long")
    # Every column as a tree of its own, so that the best cut of each is chosen.
    best = best_cuts(counts.withColumn("tree", F.col("feature")))
    name = F.element_at(F.array(*[F.lit(c) for c in binned.encoded]), (F.col("feature") + 1).cast("int"))
    return best.select(name.alias("feature"), F.col("bin").cast("int").alias("bin"), "gain", "n", "s", "n_left", "s_left")


def rank_features(binned: Binned, k: int) -> DataFrame:
    """(rank, feature, importance, cumulative, selected): source columns by what their best cut gains (O-49, O-72, O-21).

    The columns of a categorical feature count as one, by the best of them;
    importance is the share of the sum, ``selected`` marks the first ``k``.
    """
    of = F.create_map(*[F.lit(v) for pair in zip(binned.encoded, binned.source, strict=True) for v in pair])
    best = root_gains(binned).groupBy(of[F.col("feature")].alias("feature")).agg(F.max("gain").alias("gain"))
    # A row per feature.
    order = Window.orderBy(F.col("gain").desc(), "feature")
    ranked = best.select("feature", F.row_number().over(order).alias("rank"), (F.col("gain") / F.sum("gain").over(Window.partitionBy())).alias("importance"))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select("rank", "feature", "importance", F.sum("importance").over(upto).alias("cumulative"), (F.col("rank") <= k).cast("int").alias("selected"))


# ---------------------------------------------------------------- scoring


class ForestModel(Model):
    """A grown forest as the last stage of a pipeline model.

    Adds the mean share of the leaves as ``probability`` and the class it is
    over a half for as ``prediction``. Bins are found in the JVM; batches of
    them go through the trees together.
    """

    def __init__(self, spec: FeatureSpec, cuts: dict[str, list[float]], levels: list[tuple[str, str]], source: list[str], trees: list[Tree]):
        super().__init__()
        self.spec, self.cuts, self.levels, self.source, self.trees = spec, cuts, levels, source, trees
        self.names = {"probability": "probability", "raw": "rawPrediction", "prediction": "prediction"}

    def copy(self, extra=None) -> ForestModel:
        other = ForestModel(self.spec, self.cuts, self.levels, self.source, self.trees)
        other.names = dict(self.names)
        return other

    def _named(self, kind: str, name: str) -> ForestModel:
        self.names[kind] = name
        return self

    def setProbabilityCol(self, name: str) -> ForestModel:  # noqa: N802 - as Spark ML's classifiers name it
        return self._named("probability", name)

    def setRawPredictionCol(self, name: str) -> ForestModel:  # noqa: N802
        return self._named("raw", name)

    def setPredictionCol(self, name: str) -> ForestModel:  # noqa: N802
        return self._named("prediction", name)

    def share(self) -> Column:
        """Mean share of the leaves that a row falls into."""
        bins = [F.expr(bin_sql(c, self.cuts[c])).cast("short") for c in self.spec.numeric]
        marks = [F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("short"), F.lit(0).cast("short")) for c, v in self.levels]
        trees = self.trees

        def mean(*columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy() for c in columns]).astype(np.int64)
            total = np.zeros(len(x))
            for tree in trees:
                total += tree.value[tree.route(x)]
            return pd.Series(total / len(trees))

        return F.pandas_udf(mean, "double")(*bins, *marks)

    def _transform(self, df: DataFrame) -> DataFrame:
        ship(df.sparkSession)
        out = df.withColumn("_share", self.share())
        p = F.col("_share")
        pair = F.array(F.lit(1.0) - p, p)
        added = {
            self.names["raw"]: array_to_vector(F.transform(pair, lambda v: v * F.lit(float(len(self.trees))))),
            self.names["probability"]: array_to_vector(pair),
            self.names["prediction"]: (p > 0.5).cast("double"),
        }
        return out.withColumns({name: c for name, c in added.items() if name}).drop("_share")

    def gains(self) -> dict[str, float]:
        """Share of the fall of impurity by source column, each tree counting alike."""
        total: dict[str, float] = {}
        for tree in self.trees:
            whole = sum(tree.gain.values())
            for node, gain in tree.gain.items():
                name = self.source[int(tree.feature[node])]
                total[name] = total.get(name, 0.0) + gain / whole
        every = sum(total.values())
        return {c: v / every for c, v in total.items()}


def forest_model(binned: Binned, spec: FeatureSpec, trees: list[Tree]) -> ForestModel:
    return ForestModel(spec, binned.cuts, binned.levels, binned.source, trees)


# ---------------------------------------------------------------- out of bag


@dataclass
class Ballot:
    """A tree's votes without walking it.

    A bit stands for each place of the last level. ``masks[f][v]`` are the
    places that a row with bin v of feature f can still reach; all features'
    masks together leave the places below the row's leaf. ``voted`` are the
    places that vote for class 1. Only features that the tree uses have masks.
    """

    masks: dict[int, np.ndarray]
    voted: np.ndarray

    @classmethod
    def of(cls, tree: Tree, width: int) -> Ballot:
        size = len(tree.feature) // 2
        open_ = {int(f): np.ones((width, size), dtype=bool) for f in np.unique(tree.feature[tree.feature >= 0])}
        voted = np.zeros(size, dtype=bool)

        def walk(node: int, begin: int, end: int) -> None:
            f, mid = int(tree.feature[node]), (begin + end) // 2
            if f < 0:
                voted[begin:end] = tree.value[node] > 0.5
                return
            cut = int(tree.cut[node]) + 1
            open_[f][:cut, mid:end] = False
            open_[f][cut:, begin:mid] = False
            walk(2 * node, begin, mid)
            walk(2 * node + 1, mid, end)

        walk(1, 0, size)
        return cls({f: cls._words(m) for f, m in open_.items()}, cls._words(voted[None, :])[0])

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        filled = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
        filled[:, : bits.shape[1]] = bits
        return np.packbits(filled, axis=1, bitorder="little").view("<u8")

    def reach(self, f: int, x: np.ndarray) -> np.ndarray:
        return self.masks[f][x]

    def count(self, reached: list[np.ndarray], rows: int) -> np.ndarray:
        """Class of each row from its masks of the used features."""
        if not reached:
            return np.full(rows, bool(self.voted.any()))
        left = functools.reduce(np.bitwise_and, reached) & self.voted
        return left[:, 0] != 0 if left.shape[1] == 1 else (left != 0).any(axis=1)

    def votes(self, x: np.ndarray) -> np.ndarray:
        return self.count([self.reach(f, x[:, f]) for f in self.masks], len(x))


def _oob_counts(trees: list[Tree], grid: Sequence[int], features: int, width: int):
    ballots = [Ballot.of(tree, width) for tree in trees[: max(grid, default=0)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, wrong = np.zeros((len(grid), 2), dtype=np.int64), np.zeros((len(grid), 2), dtype=np.int64)
        seen = False
        for h, first, label, x in _cells(batches, features):
            seen = True
            size = np.diff(np.r_[first, len(h)])
            y = np.repeat(label, size)
            votes, margin = (np.zeros(len(h), dtype=np.int32) for _ in range(2))
            for t, ballot in enumerate(ballots):
                out = bag_weights(h, t) == 0
                for_one = np.repeat(ballot.votes(x), size)
                votes += out
                margin += np.where(for_one, out, -out.astype(np.int8))
                if t + 1 in grid:
                    k = grid.index(t + 1)
                    voted = votes > 0
                    n[k] += np.bincount(y[voted], minlength=2)[:2]
                    missed = voted & ((margin > 0) != (y == 1))
                    wrong[k] += np.bincount(y[missed], minlength=2)[:2]
        if seen:  # a task without rows says nothing
            columns = [pa.array(c, pa.int64()) for c in (grid, n[:, 0], n[:, 1], wrong[:, 0], wrong[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["trees", "n_0", "n_1", "wrong_0", "wrong_1"])

    return run


def oob_error_curve(binned: Binned, trees: list[Tree], grid: Sequence[int] = (1, 5, 10, 20, 50, 100)) -> DataFrame:
    """(trees, n, error, error_0, error_1): out-of-bag error of the first trees (O-71).

    Each row is voted on by those of the trees whose bag does not hold it; rows
    that all of them hold have no vote and are not in ``n``. Even votes go to
    class 0. The two classes' own errors stand beside the overall one.
    """
    grid = sorted({k for k in grid if k <= len(trees)})
    counted = binned.rows.mapInArrow(_oob_counts(trees, grid, len(binned.encoded), binned.width), "trees long, n_0 long, n_1 long, wrong_0 long, wrong_1 long")
    s = counted.groupBy("trees").agg(*[F.sum(c).alias(c) for c in ("n_0", "n_1", "wrong_0", "wrong_1")])
    return s.select(
        F.col("trees").cast("int").alias("trees"),
        (F.col("n_0") + F.col("n_1")).alias("n"),
        F.try_divide(F.col("wrong_0") + F.col("wrong_1"), F.col("n_0") + F.col("n_1")).alias("error"),
        F.try_divide("wrong_0", "n_0").alias("error_0"),
        F.try_divide("wrong_1", "n_1").alias("error_1"),
    )


def _permuted_hits(trees: list[Tree], columns: dict[str, list[int]], features: int, width: int, seed: int):
    ballots = [Ballot.of(tree, width) for tree in trees]

    def run(key: tuple[pa.Scalar], rows: pa.Table) -> pa.Table:
        # The order follows from the rows; equal rows may stand either way.
        rows = rows.drop_columns("bucket")
        rows = rows.sort_by([(c, "ascending") for c in rows.column_names])
        h, y, x = _matrix(rows, features)
        positive = y == 1
        out: list[tuple[int, str, int, int]] = []
        for t, ballot in enumerate(ballots):
            own = np.flatnonzero(bag_weights(h, t) == 0)
            reached = {f: ballot.reach(f, x[own, f]) for f in ballot.masks}
            label = positive[own]
            right = int((ballot.count(list(reached.values()), len(own)) == label).sum())
            for i, (name, at) in enumerate(columns.items()):
                hits = right
                if reached.keys() & set(at):
                    order = np.random.default_rng([seed, key[0].as_py(), t, i]).permutation(len(own))
                    mixed = [m[order] if f in at else m for f, m in reached.items()]
                    hits = int((ballot.count(mixed, len(own)) == label).sum())
                out.append((t, name, len(own), right - hits))
        return pa.table(dict(zip(("tree", "feature", "n", "lost"), map(list, zip(*out, strict=True)), strict=True)))

    return run


def oob_importance(binned: Binned, trees: list[Tree], seed: int = SEED) -> DataFrame:
    """(feature, accuracy_drop, standard_error, z, gini_drop) by source column (O-70).

    For each tree: the share of right votes on the rows outside its bag, less
    the same with the column's values permuted among those rows. The drop is
    the mean of these paired differences, its standard error their spread over
    the root of the number of trees, z the quotient (null without spread).
    ``gini_drop`` is the fall of n * Gini impurity at the column's cuts, per
    tree. Rows are permuted inside buckets of their key hash of about
    PERMUTED_ROWS rows, so no task holds more; the columns of a categorical
    feature move together.
    """
    n = binned.rows.count()
    buckets = max(1, -(-n // PERMUTED_ROWS))
    columns: dict[str, list[int]] = {}
    for i, c in enumerate(binned.source):
        columns.setdefault(c, []).append(i)
    dealt = binned.rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    permuted = _permuted_hits(trees, columns, len(binned.encoded), binned.width, seed)
    hits = dealt.groupBy("bucket").applyInArrow(permuted, "tree long, feature string, n long, lost long")
    per_tree = hits.groupBy("feature", "tree").agg(F.try_divide(F.sum("lost"), F.sum("n")).alias("d"))
    mean, square = F.avg("d"), F.avg(F.col("d") * F.col("d"))
    spread = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)) / F.count("d"))
    gini = [(c, float(sum(g for tree in trees for node, g in tree.gain.items() if tree.feature[node] in at) / len(trees))) for c, at in columns.items()]
    found = per_tree.groupBy("feature").agg(mean.alias("accuracy_drop"), spread.alias("standard_error"))
    found = found.withColumn("z", F.try_divide("accuracy_drop", "standard_error"))
    # A row per feature.
    drops = binned.rows.sparkSession.createDataFrame(gini, "feature string, gini_drop double")
    return found.join(F.broadcast(drops), "feature")
