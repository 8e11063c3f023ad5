"""A Spark-first analytics engine for file-based knowledge bases."""
