"""Operators for training data: grouping of matches, exact percentiles, co-occurrence, vector search, packing, mixing and content scoring."""
