"""Operators for text and set data that feed language-model training."""
