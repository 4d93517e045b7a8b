"""A Spark-first multi-model analytics engine: relational, keyed structures, text, vectors, hybrid search."""
