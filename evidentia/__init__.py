"""Evidence retrieval and data processing on Spark."""
