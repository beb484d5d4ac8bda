"""Operators of a training-data pipeline: packing, filtering, deduplication, tokenising."""
