"""Ordered columnar tables and N-dimensional arrays on Spark DataFrames."""

__version__ = "0.1.0"
