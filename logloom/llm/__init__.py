"""Operators of training-data pipelines: dedup, quality, tokens, mixing, packing.

Nothing else in the library imports this package; it may import the rest.
"""
