"""Operators for preparing training data: scans, deduplication, search, filters, mixing, packing."""
