"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` holds the thin registered
queries.
"""
