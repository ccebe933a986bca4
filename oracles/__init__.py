"""Checking SQL for DuckDB, one text per registered query."""
