"""Column-level functions the operators share."""
