"""Operators of a training-data pipeline: extraction, packing, filtering, dedup, scans, mixing, search."""
