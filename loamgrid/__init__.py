"""Geometric annotations on Spark: lookups by id, relation, grid cell and bounding box."""
