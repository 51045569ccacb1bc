"""Operators for training-data pipelines and their sketches.  Nothing outside this package imports it."""
