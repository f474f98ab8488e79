"""Operators of a training-data pipeline: archives, deduplication, filters, tokens and packing."""
