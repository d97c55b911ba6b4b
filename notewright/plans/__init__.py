"""Registered queries: one per inventory row, with the DuckDB statement that must give the same rows."""
