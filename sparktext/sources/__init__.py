"""Readers of documents, and stores of indexes."""
