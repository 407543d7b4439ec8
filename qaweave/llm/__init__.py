"""Operators of a large training-data pipeline, one module for each."""
