"""Spark-first analytics over versioned code-graph tables."""

__version__ = "0.1.0"
