"""Operators for training-data pipelines. Optional: nothing outside this package imports it."""
