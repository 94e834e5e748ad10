"""Planar geometry and planar graph analytics on Spark tables."""
