"""Column-level building blocks (Column -> Column)."""
