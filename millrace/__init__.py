"""Spark-native engine for building and auditing language-model training data."""

__version__ = "0.1.0"
