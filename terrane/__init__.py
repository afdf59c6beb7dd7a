"""Landscape mapping of large numeric tables on Spark."""
