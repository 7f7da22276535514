"""Operators for training data: entity names, vectors, personal information, duplicates, leakage, mixing, subjects."""
