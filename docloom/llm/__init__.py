"""Operators of a training-data pipeline: quality, formatting, deduplication, filtering, mixing, scoring.

Nothing outside this subpackage imports it.
"""
