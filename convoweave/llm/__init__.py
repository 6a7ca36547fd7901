"""Operators of a training-data pipeline over whole corpora.

Each operator is a module with functions from DataFrames to DataFrames; ``queries``
applies them to the given tables. The rest of the library does not import this.
"""
