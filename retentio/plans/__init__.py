"""Catalog of inputs, query registry, DuckDB oracle SQL and batch runner."""
