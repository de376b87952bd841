"""functions of the screening engine."""
