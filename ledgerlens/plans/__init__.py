"""Composed plans: the query registry (Spark side + DuckDB oracle SQL)."""
