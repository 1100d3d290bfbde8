"""Compiles chat exports into a clean message set on Spark."""

__version__ = "0.1.0"
