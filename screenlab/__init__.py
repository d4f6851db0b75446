"""Spark DataFrame operators for pooled-screen analytics."""

__version__ = "0.1.0"
