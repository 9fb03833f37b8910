"""Operators for large training-data pipelines: scoring, dedup, mixing, tokens, media."""
