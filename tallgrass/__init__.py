"""Tallgrass: a Spark-native engine for rollout, reward and training-text data."""

__version__ = "0.1.0"
