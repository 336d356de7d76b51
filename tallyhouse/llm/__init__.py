"""Operators for preparing training data: deduplication, search, filtering, archives, packing."""
