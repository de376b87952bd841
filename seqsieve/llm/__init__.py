"""Training-data operators: extraction, filters, deduplication, scoring, packing."""
