"""streaming of the screening engine."""
