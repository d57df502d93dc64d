"""Operators of a training-data pipeline: scoring, de-duplication, search,
mixing, packing and sharding of documents and vectors.

Nothing else in the library imports this subpackage.
"""
