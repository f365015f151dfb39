"""DataFrame -> DataFrame operators with explicit key columns."""
