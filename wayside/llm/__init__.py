"""Operators for preparing training text: filters, near-duplicates, pseudonyms, mixing, formatting, tokens."""
