"""The registered queries, by subject, each with its DuckDB counterpart."""
