"""plans of the screening engine."""
