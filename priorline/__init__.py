"""Point-in-time performance analytics on Spark DataFrames."""

__version__ = "0.1.0"
