"""Sources of the knowledge-base engine."""
