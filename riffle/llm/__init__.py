"""Operators of a training-data pipeline: formatting, deduplication, filtering, scoring, packing."""
