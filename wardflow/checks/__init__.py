"""Verification helpers: DuckDB oracle SQL, result comparison, plan facts."""
