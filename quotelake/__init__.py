"""Procurement-quote analytics as set-based PySpark jobs."""

__version__ = "0.1.0"
