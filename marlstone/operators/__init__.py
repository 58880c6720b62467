"""Relational operators: scan, filter, aggregate, top-k."""
