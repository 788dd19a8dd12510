"""End-to-end plans, the materialised inputs per table folder, and the query
registry with its DuckDB oracle SQL."""
