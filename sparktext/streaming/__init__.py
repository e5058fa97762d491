"""Structured Streaming: indexes, counts and feedback that grow as documents arrive."""
