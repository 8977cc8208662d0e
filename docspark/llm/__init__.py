"""Training-data operators: deduplication, tokenisation, extraction, archives, scans and language ID.

Nothing else in the library imports this subpackage; it can be deleted with its tests.
"""
