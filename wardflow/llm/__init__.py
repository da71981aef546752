"""Training-data operators: filtering, deduplication, mixing and packing of text corpora."""
