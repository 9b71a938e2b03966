"""Operators of a training-data pipeline: scoring, filtering, joining, formatting and packing of text."""
