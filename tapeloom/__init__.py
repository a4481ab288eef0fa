"""Spark-native analytics over market bars, statements, factors and event tables."""

__version__ = "0.1.0"
