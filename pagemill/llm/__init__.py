"""Training-data operators: extraction, filtering, deduplication, packing and search over web-scale tables."""
