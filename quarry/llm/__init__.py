"""Operators for training-data pipelines over large corpora."""
