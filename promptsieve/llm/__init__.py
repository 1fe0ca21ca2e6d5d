"""Operators of a large-scale training-data pipeline, their queries and SQL."""
