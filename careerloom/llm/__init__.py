"""Operators for large training-data pipelines: search, privacy, deduplication, scoring, mixing, tokens."""
