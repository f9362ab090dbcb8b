"""Operators for preparing training data: dedup, quality, secrets, mixing, packing, search, archives."""
