"""Operators of a training-data pipeline: search, filtering, deduplication, encoding, packing."""
