"""Operators and queries of a pipeline for training data."""
