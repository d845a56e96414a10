"""Iterative plans: component algorithms, and what cuts their lineage."""
