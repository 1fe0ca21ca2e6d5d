"""Prompt screening on Spark: signals, features, scorers, models and feedback."""
