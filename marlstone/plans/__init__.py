"""Canned queries and the query registry."""
