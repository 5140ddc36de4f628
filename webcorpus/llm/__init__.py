"""Operators for building training data from large corpora. Nothing else in the library imports this subpackage."""
