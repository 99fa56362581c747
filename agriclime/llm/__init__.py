"""Operators for training-data pipelines: text quality, duplicates, search, tokens."""
