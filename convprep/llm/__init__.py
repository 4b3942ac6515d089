"""Operators of a training-data pipeline: quality, near-duplicates, language
models, personal data, mixing, packing, sharding and language id.

Nothing else in the library imports this subpackage; ``catalog`` holds its
registered queries.
"""
