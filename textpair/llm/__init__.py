"""Operators for building training data out of web documents.

Nothing else in the library imports this package.
"""
