"""Typed expressions and casts."""
