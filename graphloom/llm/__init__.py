"""Operators for preparing training data. Nothing else in graphloom imports this package."""
