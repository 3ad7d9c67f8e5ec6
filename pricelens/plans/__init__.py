"""Composed queries over the panel views, each paired with a DuckDB oracle."""
