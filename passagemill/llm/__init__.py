"""Operators for training data: each module holds one, ``queries`` applies them to the test tables."""
