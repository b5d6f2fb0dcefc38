"""Operators of a training-data pipeline over the documents table; nothing else in the library imports this package."""
