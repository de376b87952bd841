"""sources of the screening engine."""
