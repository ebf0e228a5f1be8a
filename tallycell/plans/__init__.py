"""Registered queries over the given tables, and multi-stage compositions of operators."""
