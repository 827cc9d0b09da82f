"""Driver-table fixtures, the query catalogue and its DuckDB oracle."""
