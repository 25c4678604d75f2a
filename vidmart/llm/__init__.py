"""Training-data operators: tokens, search, filters, near and substring dedup, packing."""
