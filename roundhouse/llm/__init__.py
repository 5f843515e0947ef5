"""Training-data operators: search, deduplication, mixing, scoring, packing, personal data."""
