"""Queries composed of several operators."""
