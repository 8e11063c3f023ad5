"""Functions of the knowledge-base engine."""
