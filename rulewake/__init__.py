"""Spark-first analytics for regulatory texts, the comments on them and the labels given to both."""

__version__ = "0.1.0"
