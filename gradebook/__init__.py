"""Spark operators for evaluation and post-training data."""
