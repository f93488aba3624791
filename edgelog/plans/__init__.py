"""Named analytic queries, the lake builder, the query registry and its
DuckDB oracle texts."""
