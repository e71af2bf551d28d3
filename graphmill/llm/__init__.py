"""Operators for training data made from text and code; nothing outside imports this package."""
