"""Operators of a training-data pipeline: extraction, filtering, deduplication, mixing and encoding of text."""
