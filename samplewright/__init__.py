"""Spark-first engine for building and auditing verified training samples."""

__version__ = "0.1.0"
