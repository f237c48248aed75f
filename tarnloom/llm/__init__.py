"""Operators for training data: splits, duplicates, encoding repair, leakage,
shared spans, grouping and tokenization.  Nothing else in tarnloom imports
this subpackage."""
