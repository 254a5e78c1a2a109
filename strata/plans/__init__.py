"""Query catalogue on the test tables and its SQL oracles."""
