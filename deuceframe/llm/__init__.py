"""Operators for building training data: deduplication, resolution, ranking, matching, tokens, packing, truncation."""
