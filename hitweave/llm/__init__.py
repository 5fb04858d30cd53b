"""Operators for large text collections and model training data. Nothing else in the library imports this package."""
