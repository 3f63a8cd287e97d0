"""All queries of the core, with the SQL that states the same result."""

from __future__ import annotations

from quartzbar.plans import bars, checks, evaluation, files, further, governing, learning_data, operations, raw_data

MODULES = (raw_data, bars, learning_data, evaluation, governing, operations, checks, further, files)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
# The nearest funding, stated beside the last one before.
SQL["features_funding"] = further.NEAREST_FUNDING_SQL
FLAGSHIP = "canonical_timeline"
