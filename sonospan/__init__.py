"""Spark-first analytics for time-aligned speech corpora."""

__version__ = "0.1.0"
