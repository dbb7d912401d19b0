"""Structured Streaming forms of the edit-log operators."""
