"""Operators over the long count table, grouped by analysis stage."""
