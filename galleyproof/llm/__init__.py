"""Operators for preparing training text: deduplication, filtering, encoding, sharding, search and decontamination.

Nothing else in the library imports this subpackage.
"""
