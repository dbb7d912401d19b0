"""Operators for building training data: screening, de-duplication, mixing, formatting, encoding."""
