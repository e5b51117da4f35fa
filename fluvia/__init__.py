"""Fluvia: terrain-and-water analytics as Spark plans."""
