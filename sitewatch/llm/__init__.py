"""Training-data operators: sharding, deduplication, quality, scoring, encoding, packing."""
