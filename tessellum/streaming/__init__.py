"""Streaming of the knowledge-base engine."""
