"""DataFrame operators with time-series semantics."""
