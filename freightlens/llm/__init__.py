"""Training-data operators (LM scoring, dedup, packing, filters) and their queries."""
