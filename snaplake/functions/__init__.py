"""Column functions: tolerant scalars and nested-data look-ups."""
