"""Iteration, and tables of polygons and graphs derived from given tables."""
