"""Operators on source and document texts for training-data pipelines."""
