"""Operators for preparing training data: scans, tokenising, packing, near-duplicate removal and quality rules."""
