"""Column -> Column helpers (O-11 … O-23). All built-in expressions: they stay
inside whole-stage codegen, no Python runs per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """Ratio that yields null on a zero denominator (O-11); ANSI ``/`` would raise."""
    return F.try_divide(_c(num), _c(den))


def scale_unit(col: str | Column, unit: float = 1e6) -> Column:
    """Unit scaling (O-12), e.g. people -> millions. The unit is explicit."""
    return _c(col) / F.lit(float(unit))


def recode(col: str | Column, mapping: Mapping, otherwise_keep: bool = True) -> Column:
    """Value recode (O-13): mapped values get their label, the rest stay as they were (as text)."""
    c = _c(col)
    expr = None
    for src, dst in mapping.items():
        cond = c == F.lit(src)
        expr = F.when(cond, F.lit(dst)) if expr is None else expr.when(cond, F.lit(dst))
    fallback = c.cast("string") if otherwise_keep else F.lit(None).cast("string")
    return fallback if expr is None else expr.otherwise(fallback)


def binarise(col: str | Column, cutpoint: float = 0.5) -> Column:
    """Strict ``x > cutpoint`` -> 1.0 else 0.0 (O-14); null and NaN stay missing."""
    known = nan_to_null(_c(col).cast("double"))
    return F.when(known > F.lit(cutpoint), F.lit(1.0)).when(known.isNotNull(), F.lit(0.0))


def label_if(cond: Column, label: str | Column, otherwise: str = "") -> Column:
    """Outlier label (O-15): the label where ``cond`` holds, else an empty string."""
    return F.when(cond, _c(label)).otherwise(F.lit(otherwise))


def to_text(col: str | Column) -> Column:
    """Identifier to string (O-16), e.g. FIPS so it is never scaled."""
    return _c(col).cast("string")


def to_number(col: str | Column, dtype: str = "double") -> Column:
    """Text to number with bad values -> null (O-16); a plain ANSI cast raises."""
    return _c(col).try_cast(dtype)


def paste(*cols: str | Column, sep: str = "-", na: str = "NA") -> Column:
    """``paste(a, b, sep)`` (O-18): nulls print as ``NA`` instead of being skipped."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit(na)) for c in cols])


def strip_prefix(col: str | Column, prefix: str) -> Column:
    """Remove a leading literal prefix once (O-19)."""
    return F.regexp_replace(_c(col), "^" + _escape(prefix), "")


def text_length(col: str | Column) -> Column:
    """Character length (O-20)."""
    return F.char_length(_c(col))


def record_counter() -> Column:
    """Constant 1 per row (O-22); summing it is ``count(*)``."""
    return F.lit(1)


def fixed_bin(col: str | Column, size: float = 0.1, peg: float = 0.0, top_bin: int | None = None) -> Column:
    """Fixed-width bin ordinal ``floor((x - peg) / size)`` (O-23).

    ``top_bin`` folds values on the closed upper edge (x = 1.0 with size 0.1
    gives bin 10) into the last bin of a fixed palette.
    """
    b = F.floor((_c(col) - F.lit(peg)) / F.lit(size)).cast("int")
    return F.least(b, F.lit(top_bin)) if top_bin is not None else b


def nan_to_null(col: str | Column) -> Column:
    """R treats NaN and NA alike; Spark aggregates skip null but not NaN."""
    c = _c(col)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def attr(col: str | Column) -> Column:
    """BI-tool ``ATTR``: the value if every non-null value in the group is equal, else null (O-43b)."""
    c = _c(col)
    return F.when(F.min(c) == F.max(c), F.min(c))


def _escape(text: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()" else ch for ch in text)
