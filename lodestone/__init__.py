"""Lodestone: a PySpark-native engine for source-code and text analytics."""

__version__ = "0.1.0"
