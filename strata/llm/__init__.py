"""Operators for large text corpora: de-duplication, filters, packing, search.

Nothing outside this folder imports it. Every operator takes DataFrames and
returns a DataFrame; ``catalogue`` binds them to the given tables.
"""
