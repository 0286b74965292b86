"""Operators that prepare text and records for model training."""
