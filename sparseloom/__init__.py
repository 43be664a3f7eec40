"""Similarity search with learned sparse binary codes, on PySpark DataFrames."""

__version__ = "0.1.0"
