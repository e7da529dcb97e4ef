"""Operators on cubes and feature tables."""
