"""granary: a relational analytics engine declared entirely on Spark DataFrames and Spark SQL."""

__version__ = "0.1.0"
