"""Operators for preparing training text: search, deduplication, extraction, filtering, tokens and shards.

Nothing else in the library imports this subpackage.
"""
