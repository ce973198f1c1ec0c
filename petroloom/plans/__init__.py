"""Whole programs: pose-graph optimisation and mosaics."""
