"""DataFrame-level operators (DataFrame -> DataFrame)."""
