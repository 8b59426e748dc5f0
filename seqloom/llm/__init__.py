"""Operators for preparing language-model training data on Spark DataFrames.

Each module holds one operator with a general interface; ``registry`` holds the
thin queries over the standard tables and their SQL.
"""
