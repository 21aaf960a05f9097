"""Operators for training-data pipelines: text, token and vector tables."""
