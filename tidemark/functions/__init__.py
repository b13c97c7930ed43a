"""Vocabularies and column functions."""
