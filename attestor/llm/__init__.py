"""Operators for large-scale training-data preparation.

Nothing else in the library imports this package; its ``queries`` are
picked up by ``__spark_entry__`` when it is present.
"""
