"""Operators of a training-data pipeline: scoring, extraction, search, mixing,
sharding, near-duplicate joins, language identification and tokenisation.

Nothing outside this subpackage imports it.
"""
