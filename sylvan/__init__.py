"""sylvan: querying and reshaping HTML collections with Spark DataFrames."""

__version__ = "0.1.0"
