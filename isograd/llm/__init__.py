"""Operators of a training-data pipeline: counting, deduplication, filtering, mixing, archives, search."""
