"""Exact nearest-neighbour scoring and corpus preparation as Spark plans."""
