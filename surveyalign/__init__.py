"""Spark operators for aligning repeated household travel surveys."""

__version__ = "0.1.0"
