"""Group profiles and reshaping (O-28, O-40 … O-43c, O-53 … O-55, O-79 … O-86).

Every published profile has the same shape: (join) -> group -> aggregate a
chosen metric list -> (composite key) -> wide-to-long. The metric list is
applied *before* the aggregate, so a later filter on ``variable`` never makes
Spark compute aggregates that are thrown away (Catalyst does not push a
filter on the unpivoted ``variable`` below the ``Expand``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType, NumericType, StructField

from strata.functions.scalar import nan_to_null, paste, strip_prefix, attr
from strata.schema import Roles, numeric_columns

def _agg_expr(name: str, how: str, na_rm: bool = True) -> Column:
    c = nan_to_null(F.col(name))
    if how == "mean":
        e = F.avg(c)
    elif how == "sum":
        e = F.sum(c)
    elif how == "count":
        e = F.count(c)
    elif how == "min":
        e = F.min(c)
    elif how == "max":
        e = F.max(c)
    else:
        raise ValueError(f"unknown aggregate {how!r}")
    if not na_rm and how in ("mean", "sum"):
        # R without na.rm: a single missing value makes the group result NA.
        e = F.when(F.count(c) == F.count(F.lit(1)), e)
    return e.alias(name)


def aggregate_metrics(
    df: DataFrame,
    groups: Sequence[str],
    metrics: Sequence[str] | None = None,
    how: str = "mean",
    na_rm: bool = True,
    roles: Roles | None = None,
) -> DataFrame:
    """Grouped mean/sum of every numeric (or the named) column (O-40, O-41, O-42, O-32).

    One partial + final hash aggregate: the partial step combines rows map-side,
    so a hot group costs one row per task in the shuffle, not all its rows.
    """
    roles = roles or Roles(groups=tuple(groups))
    metrics = list(metrics) if metrics is not None else numeric_columns(df, roles)
    return df.groupBy(*groups).agg(*[_agg_expr(m, how, na_rm) for m in metrics])


def to_long(
    df: DataFrame,
    ids: Sequence[str] | None = None,
    values: Sequence[str] | None = None,
    variable: str = "variable",
    value: str = "value",
) -> DataFrame:
    """Wide -> long (O-53, O-54). Default ids are the non-numeric columns, as ``melt`` does.

    Value columns are cast to one common type first (unpivot needs it); null
    values are kept, as ``melt`` keeps NA.
    """
    if ids is None:
        ids = [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType)]
    if values is None:
        values = [c for c in df.columns if c not in set(ids)]
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = all(isinstance(types[v], IntegralType) for v in values)
    target = "bigint" if integral else "double"
    casted = df.select(*ids, *[F.col(v).cast(target).alias(v) for v in values])
    return casted.unpivot(list(ids), list(values), variable, value)


def profile(
    df: DataFrame,
    groups: Sequence[str],
    metrics: Sequence[str] | None = None,
    how: str = "mean",
    key: str | None = None,
    key_sep: str = "-",
    long: bool = True,
    na_rm: bool = True,
) -> DataFrame:
    """The published-profile pipeline (O-84, O-85, O-81, O-80).

    ``key`` replaces the group columns by one composite text key built with
    ``paste`` semantics (``prediction-METRO``).
    """
    wide = aggregate_metrics(df, groups, metrics, how, na_rm)
    ids = list(groups)
    if key:
        wide = wide.select(paste(*groups, sep=key_sep).alias(key), *[c for c in wide.columns if c not in groups])
        ids = [key]
    if not long:
        return wide
    return to_long(wide, ids=ids)


def topic_profile(
    df: DataFrame,
    groups: Sequence[str],
    topics: Mapping[str, Sequence[str]],
    topic: str,
    how: str = "mean",
) -> DataFrame:
    """Named metric topic (O-28): replaces the positional row slice of a melted table."""
    if topic not in topics:
        raise KeyError(f"unknown topic {topic!r}; known: {sorted(topics)}")
    return profile(df, groups, topics[topic], how=how)


def class_counts(df: DataFrame, groups: Sequence[str], name: str = "n") -> DataFrame:
    """``tally()`` per group (O-43, O-83)."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(name))


def flag_counts(
    df: DataFrame, group: str, flags: Sequence[str], legacy_codes: bool = False
) -> DataFrame:
    """Grouped flag sums, long form (O-43a).

    ``legacy_codes=True`` reproduces summing factor level codes 1/2, i.e.
    group size + number of flagged rows.
    """
    exprs = []
    for f in flags:
        v = F.col(f).cast("long")
        if legacy_codes:
            v = v + F.lit(1)
        exprs.append(F.sum(v).cast("long").alias(f))
    return to_long(df.groupBy(group).agg(*exprs), ids=[group], values=list(flags))


def attr_by(df: DataFrame, groups: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """``ATTR(value)`` at a grain (O-43b, O-86)."""
    return df.groupBy(*groups).agg(attr(value).alias(out or value), F.count(F.lit(1)).alias("n"))


def rollup_totals(
    df: DataFrame, levels: Sequence[str], sums: Sequence[str], count_name: str = "records"
) -> DataFrame:
    """Drill path totals (O-43c, O-22): ``rollup`` with a record count and ``grouping_id``."""
    return df.rollup(*levels).agg(
        *[F.sum(s).alias(s) for s in sums],
        F.count(F.lit(1)).alias(count_name),
        F.grouping_id().alias("level"),
    )


AGGREGATES = ("sum", "mean", "count", "min", "max", "attr")


def default_aggregate(field: StructField) -> str:
    """How a field is totalled when nothing else is said (O-43c): what its
    ``aggregate`` metadata names, else the sum of numbers and the count of others."""
    how = (field.metadata or {}).get("aggregate") or ("sum" if isinstance(field.dataType, NumericType) else "count")
    if how not in AGGREGATES:
        raise ValueError(f"{field.name}: no aggregate {how!r}")
    return how


def with_aggregate(df: DataFrame, **how: str) -> DataFrame:
    """Name the default aggregate of columns in their metadata."""
    return df.select(
        *[F.col(f.name).alias(f.name, metadata={**(f.metadata or {}), "aggregate": how[f.name]}) if f.name in how else F.col(f.name) for f in df.schema.fields]
    )


def drill_path(df: DataFrame, levels: Sequence[str], count_name: str = "records") -> DataFrame:
    """Every field by its default aggregate at each level of a drill path (O-43c, O-43b).

    Means skip missing values; ``attr`` is the value where all are equal, else
    null. Rows are first reduced to one per full path (sums, counts, least and
    greatest values), and only those are rolled up: the data is shuffled once,
    by the path, whatever the number of levels. ``level`` tells subtotals from
    null members (the grouping id: 0 at the full path).
    """
    fields = [f for f in df.schema.fields if f.name not in levels]
    how = {f.name: default_aggregate(f) for f in fields}
    parts, merged = [F.count(F.lit(1)).alias(count_name)], [F.sum(count_name).alias(count_name)]
    for f in fields:
        x = nan_to_null(F.col(f.name)) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
        s, n, lo, hi = (f"__{f.name}_{k}" for k in ("sum", "n", "lo", "hi"))
        kind = how[f.name]
        if kind in ("sum", "mean"):
            parts.append(F.sum(x).alias(s))
        if kind in ("mean", "count"):
            parts.append(F.count(x).alias(n))
        if kind in ("min", "attr"):
            parts.append(F.min(x).alias(lo))
        if kind in ("max", "attr"):
            parts.append(F.max(x).alias(hi))
        merged.append(
            {
                "sum": lambda: F.sum(s),
                "mean": lambda: F.try_divide(F.sum(s).cast("double"), F.sum(n)),
                "count": lambda: F.sum(n),
                "min": lambda: F.min(lo),
                "max": lambda: F.max(hi),
                "attr": lambda: F.when(F.min(lo) == F.max(hi), F.min(lo)),
            }[kind]().alias(f.name)
        )
    return df.groupBy(*levels).agg(*parts).rollup(*levels).agg(*merged, F.grouping_id().alias("level"))


def group_totals(
    df: DataFrame,
    groups: Sequence[str],
    sums: Mapping[str, str],
    ratio: tuple[str, str, str] | None = None,
    legacy_density: bool = False,
) -> DataFrame:
    """Group totals and their ratio (O-44), aggregate form.

    ``ratio=(out, num, den)`` adds ``num/den`` of the totals; ``legacy_density``
    multiplies it by the group size, which the reference's window form did by
    summing an already-constant ratio over the group's rows.
    """
    aggs = [F.sum(src).alias(name) for name, src in sums.items()]
    aggs.append(F.count(F.lit(1)).alias("_n"))
    out = df.groupBy(*groups).agg(*aggs)
    if ratio:
        name, num, den = ratio
        r = F.try_divide(F.col(num), F.col(den))
        if legacy_density:
            r = r * F.col("_n")
        out = out.withColumn(name, r)
    return out.drop("_n")


def year_series(
    df: DataFrame,
    groups: Sequence[str],
    prefix: str,
    unit: float = 1e6,
    na_rm: bool = False,
    year: str = "year",
    value: str = "total",
) -> DataFrame:
    """Annual series per group from year-named columns (O-55, O-79, O-10, O-12, O-19, O-42).

    As in the reference study, one missing year value makes its group's total missing
    unless ``na_rm``. The three filtered repeats in the reference are subsets of one grouped
    sum, so the sum is computed once; callers filter the long result.
    """
    cols = [c for c in df.columns if c.startswith(prefix)]
    wide = aggregate_metrics(df, groups, cols, how="sum", na_rm=na_rm)
    long = to_long(wide, ids=list(groups), values=cols, variable="_var", value="_val")
    return long.select(
        *groups,
        strip_prefix("_var", prefix).cast("int").alias(year),
        (F.col("_val") / F.lit(float(unit))).alias(value),
    )
