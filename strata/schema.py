"""Column roles and name normalisation.

The reference addresses columns by position (``final[,4:62]``); here every
operator receives named column lists, and a small ``Roles`` record says which
columns are keys, groups, the label, numeric measures and categoricals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType


@dataclass(frozen=True)
class Roles:
    keys: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    label: str | None = None
    exclude: tuple[str, ...] = field(default=())

    def protected(self) -> set[str]:
        out = set(self.keys) | set(self.groups) | set(self.exclude)
        if self.label:
            out.add(self.label)
        return out


def normalise_name(name: str) -> str:
    """``Pov.All`` -> ``Pov_All``; Spark reads ``a.b`` as a struct field."""
    out = re.sub(r"[^0-9A-Za-z_]", "_", name.strip().lstrip("﻿"))
    return out if not out[:1].isdigit() else f"_{out}"


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename every column to a safe identifier, keeping the original as metadata."""
    cols, taken = [], {}
    for f in df.schema.fields:
        new = normalise_name(f.name)
        if new in taken:
            raise ValueError(f"columns {taken[new]!r} and {f.name!r} would both become {new!r}; rename one first")
        taken[new] = f.name
        meta = dict(f.metadata or {})
        meta.setdefault("source_name", f.name)
        cols.append(F.col(f"`{f.name}`").alias(new, metadata=meta))
    return df.select(*cols)


def numeric_columns(df: DataFrame, roles: Roles | None = None) -> list[str]:
    """``select_if(is.numeric)`` minus key/group/label roles (O-9)."""
    skip = roles.protected() if roles else set()
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def non_numeric_columns(df: DataFrame, roles: Roles | None = None) -> list[str]:
    """``select_if(negate(is.numeric))`` (O-9); keys stay on this side."""
    skip = set(roles.exclude) if roles else set()
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NumericType) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """Named replacement for a positional range such as ``3:11`` over ``pop*`` (O-10)."""
    return [c for c in df.columns if c.startswith(prefix)]
