"""Operators for text and vector collections that feed language-model training."""
