"""A Spark-native engine for governed document collections, retrieval, evidence and reporting."""
