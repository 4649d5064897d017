"""Operators for training data: duplicates, truncation, leakage, near-duplicates, packing, mixing, residue."""
