"""Operators for preparing training data: each module is one operator with its own interface;
``queries`` registers one query for each over the given tables."""
