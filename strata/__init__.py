"""strata — Spark-native area profiling and binary-classification toolkit.

Everything is DataFrame / Spark SQL / Spark ML code. Sub-packages:

* ``sources``   — CSV/parquet scans, label lists, views, scored-table export
* ``functions`` — Column -> Column helpers (recode, bins, safe casts, keys)
* ``operators`` — DataFrame -> DataFrame operators (clean, joins, profiles,
  windows, set operations, statistics, evaluation, ML)
* ``plans``     — the query catalogue on the test tables and its SQL oracles
"""

from strata.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
