"""Operators for training-data pipelines.

Nothing outside this subpackage imports it; the rest of the library works
without it.
"""
