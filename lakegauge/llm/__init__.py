"""Operators for large training corpora: scans, near-duplicates, filters, tokens and packing."""
