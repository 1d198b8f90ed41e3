"""Density-based spatial clustering and its building blocks as Spark DataFrame operators."""
