"""Layered-data, key/value, search and source-corpus analytics as Spark jobs."""

__version__ = "0.1.0"
