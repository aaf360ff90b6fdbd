"""Spark-native curation of conversational training data."""

__version__ = "0.1.0"
