"""Search and preparation of large collections of text documents on Spark."""
