"""Operators for preparing language-model training data, their queries and SQL."""
