"""Composed plans: derived inputs, multi-step pipelines and the query registry."""
