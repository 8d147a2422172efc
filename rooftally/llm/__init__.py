"""Operators for preparing training data: near-duplicates, filters, search, packing and mixing."""
