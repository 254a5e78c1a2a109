"""Scans, label lists, views and sinks (O-1 … O-6)."""

from strata.sources.checked import read_csv_checked
from strata.sources.export import export_committed, manifest, read_export
from strata.sources.keyed import merge_stored, store_keyed, store_spine
from strata.sources.readers import (
    read_csv,
    read_table,
    read_label_list,
    register_view,
    to_parquet_once,
)
from strata.sources.scored_schema import SCORED_SCHEMA
from strata.sources.sinks import export_scored, with_row_index

__all__ = [
    "SCORED_SCHEMA",
    "export_committed",
    "manifest",
    "read_csv_checked",
    "read_export",
    "merge_stored",
    "read_csv",
    "read_table",
    "read_label_list",
    "register_view",
    "store_keyed",
    "store_spine",
    "to_parquet_once",
    "export_scored",
    "with_row_index",
]
