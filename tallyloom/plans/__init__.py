"""Registered queries over the driver's tables, with SQL that says the same."""

from tallyloom.plans import audit_queries, function_queries, insight_queries, model_queries, stream_queries, table_queries  # noqa: F401  (they register their queries)
