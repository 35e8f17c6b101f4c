"""Lodestone: content-based similarity search on Spark."""

__version__ = "0.1.0"
