"""Composed queries over the given tables."""
