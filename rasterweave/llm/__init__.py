"""Operators of a training-data pipeline: scoring, filtering, deduplication, tokenising and sharding of text.

Nothing else in the library imports this subpackage.
"""
