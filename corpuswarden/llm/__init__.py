"""Operators for preparing language-model training data, each with its named query."""
