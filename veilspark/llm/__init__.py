"""Operators for training-data pipelines over tables of documents.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
