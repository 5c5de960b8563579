"""Training-data operators: archives, deduplication, scoring, packing and token output."""
