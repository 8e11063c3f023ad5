"""Operators of the knowledge-base engine."""
