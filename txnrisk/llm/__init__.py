"""Operators that prepare training text: packing, sharding, extraction, search, mixing, de-duplication."""
