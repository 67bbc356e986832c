"""Spark-native graph analytics: edge tables in, DataFrames out."""

__version__ = "0.1.0"
