"""Operators that prepare training text: deduplication, filters, packing, sharding."""
