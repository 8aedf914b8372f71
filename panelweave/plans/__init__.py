"""Compositions of operators, and the fixture views built from the given tables."""
