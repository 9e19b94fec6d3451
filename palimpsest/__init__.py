"""Searchable block stores for long event logs, built on PySpark DataFrames."""

__version__ = "0.1.0"
