"""Independent SQL for the registered queries, run by DuckDB over the same tables."""
