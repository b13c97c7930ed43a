"""Tidemark: governed document-intelligence analytics on Spark."""
