"""Training-data operators: mixing, filtering, deduplication, encoding."""
