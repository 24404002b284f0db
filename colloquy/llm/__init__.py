"""Operators of a training-data pipeline: extraction, deduplication, filtering, mixing, formatting."""
