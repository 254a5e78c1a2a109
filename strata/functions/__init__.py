"""Column-level helpers."""

from strata.functions.scalar import (
    attr,
    binarise,
    fixed_bin,
    label_if,
    nan_to_null,
    paste,
    recode,
    record_counter,
    safe_ratio,
    scale_unit,
    strip_prefix,
    text_length,
    to_number,
    to_text,
)

__all__ = [
    "attr",
    "binarise",
    "fixed_bin",
    "label_if",
    "nan_to_null",
    "paste",
    "recode",
    "record_counter",
    "safe_ratio",
    "scale_unit",
    "strip_prefix",
    "text_length",
    "to_number",
    "to_text",
]
