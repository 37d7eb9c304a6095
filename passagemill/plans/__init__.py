"""Whole jobs composed from the operators, and the query registry."""
