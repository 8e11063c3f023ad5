"""Plans of the knowledge-base engine."""
