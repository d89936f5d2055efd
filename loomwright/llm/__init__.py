"""Training-data operators: deduplication, filtering, extraction, packing and sanitising of text corpora."""
