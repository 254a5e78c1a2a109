"""Statistics: standardisation (O-58, O-39) and local regression (O-57, O-26)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.scalar import nan_to_null
from strata.operators.ranks import order_statistics
from strata.operators.window import bounded_broadcast, join_on_groups


@dataclass
class Standardizer:
    """Fitted z-score: per-column mean and sample standard deviation."""

    means: dict
    sds: dict
    constant: str = "nan"  # R gives NaN for a constant column; "zero" gives 0 like StandardScaler

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale the fitted columns in place, in one projection (no split and re-bind)."""
        cols = []
        for f in df.schema.fields:
            name = f.name
            if name not in self.means:
                cols.append(F.col(name))
                continue
            mean, sd = self.means[name], self.sds[name]
            if mean is None:
                cols.append(F.lit(None).cast("double").alias(name))
            elif sd is None or sd == 0.0:
                const = float("nan") if self.constant == "nan" else 0.0
                cols.append(F.when(F.col(name).isNotNull(), F.lit(const)).cast("double").alias(name))
            else:
                cols.append(((F.col(name).cast("double") - F.lit(mean)) / F.lit(sd)).alias(name))
        return df.select(*cols)


def fit_standardizer(df: DataFrame, columns: Sequence[str], constant: str = "nan") -> Standardizer:
    """One aggregate pass over all columns; 2 x k scalars return to the driver
    and are inlined as literals, so ``transform`` needs no join at all."""
    aggs = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        aggs.append(F.avg(x).alias(f"m__{c}"))
        aggs.append(F.stddev_samp(x).alias(f"s__{c}"))
    row = df.agg(*aggs).first()
    return Standardizer(
        {c: row[f"m__{c}"] for c in columns}, {c: row[f"s__{c}"] for c in columns}, constant
    )


def zscore(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None, constant: str = "nan") -> DataFrame:
    """Standardise ``columns`` of ``df`` (O-58). ``fit_on`` lets statistics come
    from another frame (e.g. the training split) to avoid leakage."""
    return fit_standardizer(fit_on if fit_on is not None else df, columns, constant).transform(df)


def bin2d(
    df: DataFrame,
    x: str,
    y: str,
    bins: tuple[int, int] = (20, 20),
    by: Sequence[str] = (),
) -> DataFrame:
    """Scatter data reduced to a fixed grid of equal-width cells (O-59, O-82).

    A point per row is not a publishable chart dataset at scale; this keeps at
    most ``bins[0] x bins[1]`` cells per group, each with its count and the
    mean of x and y. The x/y ranges come from one aggregate (four scalars);
    the cell counts are a partial/final hash aggregate. The top edge folds
    into the last cell.
    """
    df = df.withColumns({c: nan_to_null(F.col(c).cast("double")) for c in (x, y)})
    st = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()
    nx, ny = bins

    def cell(col: str, lo, hi, n: int):
        if lo is None or hi is None or hi == lo:
            return F.lit(0)
        return F.least(
            F.floor((F.col(col).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(float(n))),
            F.lit(n - 1),
        ).cast("int")

    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, cell(x, st["x0"], st["x1"], nx).alias("x_bin"), cell(y, st["y0"], st["y1"], ny).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"))
    )


def sample_by_class(df: DataFrame, classes: Sequence[str], keys: Sequence[str], k: int) -> DataFrame:
    """``k`` rows of each class for a scatter chart (O-59, O-82), with the class size and the inclusion rate.

    The rows with the least key hashes are taken, all of a class that has fewer:
    the same ones for any partitioning, and a larger ``k`` only adds to them.
    ``class_rows`` is the size of the class and ``rate`` the share taken, so
    totals can be estimated from the sample. The class counts bound the hash
    first (``k`` and six standard deviations pass), so about ``k`` rows of a
    class move, whatever its size. ``keys`` tell rows apart.
    """
    # Local import: the hash lives beside the splits that use it.
    from strata.operators.ml import KEY_HASHES, key_hash

    sizes = df.groupBy(*classes).agg(F.count(F.lit(1)).alias("class_rows"))
    hashed = join_on_groups(df.withColumn("_h", key_hash(keys, df)), bounded_broadcast(sizes), list(classes))
    share = (F.lit(k + 6 * k**0.5 + 10) / F.col("class_rows")) * F.lit(KEY_HASHES)
    order = Window.partitionBy(*classes).orderBy("_h", *keys)
    few = hashed.filter(F.col("_h") <= share).withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k)
    return few.withColumn("rate", F.least(F.lit(1.0), F.lit(float(k)) / F.col("class_rows"))).drop("_h", "_at")


def zscore_by(df: DataFrame, columns: Sequence[str], by: Sequence[str], constant: str = "nan") -> DataFrame:
    """Standardise each group (period, dataset) on its own mean and sample sd (O-58).

    One aggregate gives one row of statistics per group; it is materialized,
    measured and broadcast when small (its size is the number of groups, not
    the data), and every row is scaled in one pass. The reference fits 2011 and 2015 separately; this
    does any number of periods without a scan per period.
    """
    aggs = []
    for c in columns:
        x = nan_to_null(F.col(c).cast("double"))
        aggs.append(F.avg(x).alias(f"_m_{c}"))
        aggs.append(F.stddev_samp(x).alias(f"_s_{c}"))
    stats = df.groupBy(*by).agg(*aggs)
    joined = join_on_groups(df, bounded_broadcast(stats), list(by))
    const = F.lit(float("nan") if constant == "nan" else 0.0)
    out = []
    for name in df.columns:
        if name in columns:
            m, sd = F.col(f"_m_{name}"), F.col(f"_s_{name}")
            scaled = F.when(F.col(name).isNull(), F.lit(None).cast("double")).when(sd == 0, const).otherwise(
                (F.col(name).cast("double") - m) / sd
            )
            out.append(scaled.alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)


# Above this many distinct x values the window per centre would hold too many
# rows in one task; the bandwidths are then searched as order statistics.
MAX_DISTINCT_X_FOR_WINDOW = 1_000_000
# How far the vertices' box reaches beyond the data, as a share of its width.
BOX_MARGIN = 0.005


def loess_trend(
    df: DataFrame,
    x: str,
    y: str,
    span: float = 0.75,
    points: int = 80,
    xlim: tuple[float, float] | None = None,
    ylim: tuple[float, float] | None = None,
    surface: str = "direct",
    cell: float = 0.2,
) -> DataFrame:
    """Local quadratic regression of ``y`` on ``x`` evaluated on an even grid (O-57).

    A local fit at a centre g: h_g is the q-th smallest |x - g| with
    q = floor(span * n); weights are tricube (1 - (d/h)^3)^3 for d < h; the
    weighted least-squares quadratic in (x - g) is solved in closed form from
    its weighted moments: intercept and slope at g.

    ``surface="direct"`` fits at every grid point. ``"interpolate"`` fits at the
    vertices of a tree of cells (``kd_cuts``: cells of more than
    span * cell * n points are cut in the middle) and blends value and slope of
    a cell's two ends by cubics, as loess does by default; its work does not
    grow with the grid.

    Distribution: rows that are null or NaN or outside ``xlim``/``ylim`` are
    dropped first (O-26). Weights depend on x only, so the data is first reduced
    to one row per distinct x (count, sum of y) by a partial/final hash
    aggregate. When the number of distinct x is bounded (checked), each centre's
    bandwidth comes from a running count over its <= MAX_DISTINCT_X_FOR_WINDOW
    rows; otherwise all bandwidths are searched together as order statistics of
    the distances, counting in place. The moments are one aggregate with a group
    per centre.
    """
    if surface not in ("direct", "interpolate"):
        raise ValueError("surface is 'direct' or 'interpolate'")
    data = df.select(nan_to_null(F.col(x).cast("double")).alias("x"), nan_to_null(F.col(y).cast("double")).alias("y"))
    data = data.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if xlim:
        data = data.filter(F.col("x").between(xlim[0], xlim[1]))
    if ylim:
        data = data.filter(F.col("y").between(ylim[0], ylim[1]))
    by_x = data.groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("sy"))
    stats = by_x.agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("m")
    ).first()
    lo, hi, n, m = stats["lo"], stats["hi"], stats["n"], stats["m"]
    if not n:
        return df.sparkSession.createDataFrame([], "g int, x double, fit double")
    q = max(int(span * n), 1)
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    if surface == "direct":
        fits = _local_fits(data, by_x, [lo + g * step for g in range(points)], q, m)
        return fits.select(F.col("g").cast("int").alias("g"), F.col("centre").alias("x"), F.col("value").alias("fit"))
    margin = BOX_MARGIN * max(hi - lo, max(abs(lo), abs(hi)) * 1e-3 + 1e-30)
    cuts = kd_cuts(data, n, int(n * span * cell))
    vertices = [lo - margin, *cuts, hi + margin]
    # One row per vertex.
    at = {r["g"]: (r["value"], r["slope"]) for r in _local_fits(data, by_x, vertices, q, m).collect()}
    ends = [
        F.struct(*[F.lit(v).cast("double").alias(k) for k, v in zip(("v0", "v1", "f0", "d0", "f1", "d1"), (vertices[i], vertices[i + 1], *at[i], *at[i + 1]), strict=True)])
        for i in range(len(vertices) - 1)
    ]
    z = F.lit(lo) + F.col("g").cast("double") * F.lit(step)
    which = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("x"))) if cuts else F.lit(0)
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("g")).withColumn("x", z)
    grid = grid.withColumn("e", F.get(F.array(*ends), which)).select("g", "x", "e.*")
    width = F.col("v1") - F.col("v0")
    h = (F.col("x") - F.col("v0")) / width
    rest = F.lit(1.0) - h
    value = rest * rest * (1 + 2 * h) * F.col("f0") + h * h * (3 - 2 * h) * F.col("f1")
    return grid.select("g", "x", (value + (h * rest * rest * F.col("d0") - h * h * rest * F.col("d1")) * width).alias("fit"))


def kd_cuts(data: DataFrame, n: int, most: int) -> list[float]:
    """Where cells of ``x`` are cut until none holds more than ``most`` of the ``n`` rows.

    A cell of rows l..u in order of x is cut halfway between two different
    neighbouring values: those around row (l + u) // 2, or the nearest that
    differ (the later ones of two as near). A cell of one value is not cut.
    Every level of the tree is a few counting passes for all its cells.
    """
    cuts: list[float] = []
    open_ = [(1, n)]
    while open_ := [(a, b) for a, b in open_ if b - a + 1 > max(most, 1)]:
        middle = {(a, b): (a + b) // 2 for a, b in open_}
        value = order_statistics(data, {"x": sorted(set(middle.values()))})["x"]
        seen = sorted(set(value.values()))
        x = F.col("x")
        row = data.agg(
            *[
                f.alias(f"{k}{i}")
                for i, v in enumerate(seen)
                for k, f in (
                    ("less", F.count_if(x < v)), ("upto", F.count_if(x <= v)),
                    ("before", F.max(F.when(x < v, x))), ("after", F.min(F.when(x > v, x))),
                )
            ]
        ).first()
        after = []
        for a, b in open_:
            m = middle[a, b]
            i = seen.index(value[m])
            near = [(r, (value[m] + other) / 2) for r, other in ((row[f"upto{i}"], row[f"after{i}"]), (row[f"less{i}"], row[f"before{i}"])) if a <= r < b]
            if near:
                r, cut = min(near, key=lambda c: abs(c[0] - m))
                cuts.append(cut)
                after += [(a, r), (r + 1, b)]
        open_ = after
    return sorted(cuts)


def _local_fits(data: DataFrame, by_x: DataFrame, centres: Sequence[float], q: int, distinct: int) -> DataFrame:
    """(g, centre, value, slope) of the weighted quadratic at each centre."""
    every = F.array(*[F.lit(float(c)) for c in centres])
    if distinct <= MAX_DISTINCT_X_FOR_WINDOW:
        pairs = by_x.select("x", "c", "sy", F.posexplode(every).alias("g", "centre"))
        pairs = pairs.withColumn("dx", F.col("x") - F.col("centre")).withColumn("d", F.abs(F.col("dx")))
        upto = Window.partitionBy("g").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
        bandwidth = pairs.withColumn("cum", F.sum("c").over(upto)).filter(F.col("cum") >= q).groupBy("g").agg(F.min("d").alias("h"))
        # A row per centre: safe to broadcast.
        pairs = pairs.join(F.broadcast(bandwidth), "g")
    else:
        away = data.select(*[F.abs(F.col("x") - F.lit(float(c))).alias(f"d{i}") for i, c in enumerate(centres)])
        found = order_statistics(away, {f"d{i}": [q] for i in range(len(centres))})
        both = F.arrays_zip(every.alias("centre"), F.array(*[F.lit(found[f"d{i}"][q]) for i in range(len(centres))]).alias("h"))
        pairs = by_x.select("x", "c", "sy", F.posexplode(both).alias("g", "at")).select("x", "c", "sy", "g", "at.centre", "at.h")
        pairs = pairs.withColumn("dx", F.col("x") - F.col("centre")).withColumn("d", F.abs(F.col("dx")))
    w = pairs.withColumn(
        "w",
        F.when(F.col("d") < F.col("h"), F.pow(1 - F.pow(F.col("d") / F.col("h"), 3), 3)).otherwise(F.lit(0.0)),
    )
    mom = w.groupBy("g", "centre").agg(
        *[F.sum(F.col("c") * F.col("w") * F.pow(F.col("dx"), k)).alias(f"s{k}") for k in range(5)],
        *[F.sum(F.col("w") * F.pow(F.col("dx"), k) * F.col("sy")).alias(f"t{k}") for k in range(3)],
    )
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    t0, t1, t2 = (F.col(f"t{k}") for k in range(3))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    value = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)
    slope = s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)
    return mom.select("g", "centre", F.try_divide(value, det).alias("value"), F.try_divide(slope, det).alias("slope"))
