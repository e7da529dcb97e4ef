"""Operators on streaming tables."""
