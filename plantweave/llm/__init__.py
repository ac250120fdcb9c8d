"""Operators for training-data pipelines on text; nothing outside this package imports it."""
