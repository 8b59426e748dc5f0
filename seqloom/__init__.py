"""Sequence containment search and compositional profiling on Spark DataFrames."""

__version__ = "0.1.0"
