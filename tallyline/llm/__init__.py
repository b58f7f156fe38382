"""Operators of a training-data pipeline: filtering, deduplication, scoring, formatting and packing of documents."""
