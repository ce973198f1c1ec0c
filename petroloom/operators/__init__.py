"""Relational operators over frames, matches, graphs and tiles."""
