"""Textloom: PySpark-native operators for text quality, evidence and corpus work."""

__version__ = "0.1.0"
