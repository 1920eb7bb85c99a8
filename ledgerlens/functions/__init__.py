"""Column functions; all are native Spark expressions except the base58 encoder."""
