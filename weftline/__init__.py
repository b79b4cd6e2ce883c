"""Weftline: a Spark-first engine for long-form text and time-coded speech records."""

__version__ = "0.1.0"
