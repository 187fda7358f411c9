"""Operators for preparing training data: deduplication, filtering, packing, output and search.

Every operator takes DataFrames and returns DataFrames. Nothing outside this package imports it.
"""
