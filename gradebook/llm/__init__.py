"""Training-data operators: deduplication, mixing, filters, extraction and retrieval."""
