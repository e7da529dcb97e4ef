"""Readers, writers and catalog of cubes and tables."""
