"""operators of the screening engine."""
