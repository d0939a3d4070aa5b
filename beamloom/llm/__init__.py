"""Training-data operators (deduplication, filtering, mixing, packing, encoding) on DataFrames."""
