"""Column-level building blocks (no DataFrame, no shuffle)."""
