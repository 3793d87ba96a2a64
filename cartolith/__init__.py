"""Spark-native engine for geospatial vector layers."""

__version__ = "0.1.0"
