"""Operators of a training-data pipeline: packing, joins, deduplication, scoring, cleaning, formatting."""
