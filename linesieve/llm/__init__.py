"""Operators for preparing training data: extraction, encoding, filtering, scoring, deduplication, search, packing."""
