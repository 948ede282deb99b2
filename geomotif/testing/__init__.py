"""Workloads: seeded random patterns and places derived from the star-schema tables."""
