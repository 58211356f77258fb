"""Operators for preparing training text: fingerprints, deduplication, filters, tokens, archives and scores."""
